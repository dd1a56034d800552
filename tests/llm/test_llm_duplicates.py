import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import decontamination, exact_dedup, simhash
from assayer.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, name string, row_no long"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "w", "n", 7) for i, t in rows], DOCS).repartition(3)


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]


# 1: exact dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40) | st.none(), st.text("ab", max_size=8)), max_size=60), st.integers(0, 3000))
def test_trie_keeps_every_text_at_any_budget(rows, budget):
    trie = exact_dedup.Trie(exact_dedup._larger, budget)
    for n, (owner, text) in enumerate(rows):
        trie.add(text.encode(), owner, n, 1, [n])
        if trie.size > budget:
            trie.spill()
    found = {text: (t.owner, t.rows, sorted(t.names)) for text, t in trie.drain()}
    wanted = defaultdict(list)
    for n, (owner, text) in enumerate(rows):
        wanted[text.encode()].append((owner, n))
    assert found == {
        text: (max((o for o, _ in own if o is not None), default=None), len(own), [n for _, n in own])
        for text, own in wanted.items()
    }


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 500])
def test_exact_dedup_equals_grouping(spark, budget):
    long = "x" * 300_000
    rows = [(1, "a b"), (2, "a b"), (9, "a b "), (3, None), (4, ""), (5, long), (6, long + "y"), (7, long), (None, "a b"),
            (None, "none"), (8, "tie"), (8, "tie")] + [(100 + i, f"text {i % 7}") for i in range(60)]
    got = exact_dedup.owners(table(spark, rows), budget=budget).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_text[r.text_sha256]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == {h: 1 for h in by_text}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_smallest_whole_rows_and_empty(spark):
    docs = table(spark, [(2, "a"), (1, "a"), (3, "b"), (3, "b")])
    kept = exact_dedup.drop_copies(docs, keep="smallest")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert exact_dedup.owners(table(spark, [])).count() == 0


# 9: SimHash


def fingerprint(text, k=3):
    ws = words(text)
    shingles = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """Brute force: smallest id reachable over pairs within the radius."""
    best = [i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for x, (_, f) in enumerate(prints):
            least = min((best[y] for y, (_, g) in enumerate(prints) if (f ^ g).bit_count() <= radius), default=best[x])
            if least < best[x]:
                best[x], changed = least, True
    return {i: b for (i, _), b in zip(prints, best)}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef gh éé IJ kl mn".split()) + str(rng.randrange(30)) for _ in range(80)) for _ in range(6)]
    rows = []
    for b in base:
        for _ in range(8):
            ws = b.split(" ")
            for _ in range(rng.randrange(4)):
                ws[rng.randrange(80)] = "changed"
            rows.append(" ".join(ws))
    rows += ["", None, " \t\n", "One", "one", "one two", "ONE\x0bTWO", "İx é", "a\xa0b c d", "same " * 40_000]
    listed = list(enumerate(rows))
    got = simhash.near_duplicates(table(spark, listed)).collect()
    prints = [(i, fingerprint(t)) for i, t in listed]
    assert {r.doc_id: r.fingerprint & (2**64 - 1) for r in got} == dict(prints)
    assert {r.doc_id: r.component_id for r in got} == classes(prints)


def test_simhash_repeated_rows_nulls_and_empty(spark):
    got = simhash.near_duplicates(table(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "alone here")]))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got.collect()) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize(("radius", "segments", "bucket"), [(3, 2, 1024), (3, 2, 4), (3, 4, 4), (1, 2, 1024)])
def test_linking_edges_lose_no_link(spark, radius, segments, bucket):
    rng = random.Random(radius * 10 + segments)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            prints.add(f)
            for _ in range(rng.randrange(3)):
                f ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    frame = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    labels = components(simhash.linking_edges(frame, radius, segments, bucket))
    label = {r.node: r.label for r in labels.collect()}
    got = defaultdict(set)
    for f in signed:
        got[label.get(f, f)].add(f)
    wanted = defaultdict(set)
    for f, c in classes([(f, f & (2**64 - 1)) for f in signed], radius).items():
        wanted[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(50)] + [(7, 7), (3, 4), (100, 101), (101, 100), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    label = {r.node: r.label for r in components(frame).collect()}
    assert len({label[i] for i in range(51)}) == 1 and label[100] == label[101] != label[0]
    assert components(frame.where("a > 1000")).count() == 0


# 6: decontamination


def similar_windows(docs, items, k=5, least=0.8):
    """Brute force over all windows of all documents."""
    def shingles(ws):
        return Counter(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else Counter()

    found = {}
    for doc_id, text in docs:
        ws = words(text)
        for item_id, wanted in items:
            its = words(wanted)
            n = len(its)
            if not n or item_id is None or (n < k and n != len(ws)):
                continue
            target = shingles(its)
            for s in range(len(ws) - n + 1):
                here = shingles(ws[s:s + n])
                score = (here & target).total() / (here | target).total()
                if score >= least - 1e-9:
                    best = found.get((doc_id, item_id), (0, 0, 0))
                    found[doc_id, item_id] = max(best, (score, -s, n))
    return {key: (round(score, 9), -s, n) for key, (score, s, n) in found.items()}


@pytest.mark.parametrize("at_once", [500_000, 120])
def test_decontamination_equals_brute_force(spark, at_once):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 9, 20, 21, 40])))) for i in range(12)]
    items += [(50, "only three words"), (51, None), (52, " "), (53, "go " * 12), (None, items[0][1]), (54, items[1][1].upper())]
    docs = []
    for d in range(80):
        ws = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            passage = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "edited"
            cut = rng.randrange(4)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage[cut:] if cut < 2 else passage
        docs.append((d, " ".join(ws)))
    docs += [(200, None), (201, ""), (202, "Only THREE\nwords"), (203, "and only three words"), (204, "go " * 5000),
             (205, items[2][1] + " " + items[2][1]), (206, docs[0][1]), (206, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(table(spark, docs), bench, at_once=at_once)
    rows = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.word_start, r.words) for r in got.collect()}
    assert rows == similar_windows(docs, items)
    assert len(rows) > 25 and min(r[0] for r in rows.values()) < 0.85


def test_decontamination_of_empty_tables(spark):
    docs, bench = table(spark, [(1, "a b c d e f g")]), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontamination.contaminated(docs, bench).count() == 1
    assert decontamination.contaminated(docs.where("doc_id > 5"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("item_id > 5")).count() == 0


def every_window(docs, items, k=5, least=0.8):
    """Brute force over all windows, a document shorter than the item being one."""
    def shingles(ws):
        return Counter(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1)))

    found = {}
    for doc_id, text in docs:
        ws = words(text)
        for item_id, wanted in items:
            its = words(wanted)
            size = min(len(its), len(ws))
            if not size or (len(its) < k and len(its) != len(ws)):
                continue
            target = shingles(its)
            for s in range(len(ws) - size + 1):
                here = shingles(ws[s:s + size])
                score = (here & target).total() / (here | target).total()
                if score >= least - 1e-9:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), (0, 0, 0)), (score, -s, size))
    return {key: (round(score, 9), -s, n) for key, (score, s, n) in found.items()}


def reported(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(table(spark, docs), bench, **options).collect()
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.word_start, r.words) for r in got}


@pytest.mark.parametrize("at_once", [500_000, 150])
def test_decontamination_of_documents_shorter_than_items(spark, at_once):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([60, 60, 59, 40, 24, 9, 10, 6, 5, 4])]
    docs = []
    for _, text in items:
        ws = text.split()
        for cut in range(len(ws) // 3):
            at = rng.randrange(cut + 1)
            docs.append((len(docs), " ".join(ws[at:len(ws) - cut + at])))
        for n in (1, 2, 3):
            edited = ws[:-n]
            edited[rng.randrange(len(edited))] = "edited"
            docs.append((len(docs), " ".join(edited)))
    docs.append((len(docs), items[0][1][:-1] + "x " + items[1][1]))
    rows = reported(spark, docs, items, at_once=at_once)
    assert rows == every_window(docs, items)
    short = [key for key, (_, _, n) in rows.items() if n < len(items[key[1]][1].split())]
    assert len(short) > 25 and min(rows[key][0] for key in short) < 0.82


def test_decontamination_of_repeated_runs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    items, docs = [], []
    for n, (prose, run) in enumerate([(95, 11), (120, 14), (200, 18), (200, 22)] * 6):
        said = rng.choices(vocabulary, k=prose)
        repeated, other = said + ["____"] * run, said + rng.choices(vocabulary, k=run)
        item, passage = (repeated, other) if n % 3 else (other, repeated)
        items.append((n, " ".join(item)))
        docs.append((n, " ".join(rng.choices(vocabulary, k=20) + passage + rng.choices(vocabulary, k=20))))
    rows = reported(spark, docs, items)
    assert rows == every_window(docs, items)
    assert len(rows) == len(items)
