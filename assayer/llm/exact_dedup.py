"""Exact duplicates: hash partitions insert whole texts into Patricia tries whose terminal nodes keep the owner."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of labels a trie may hold before it hands subtrees over.
BUDGET = 64 << 20
OUT = 2000  # rows of a batch that goes back to Spark


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _scratch_file():
    """An unnamed file on the disks to which Spark itself spills; it goes with the task."""
    disks = os.environ.get("SPARK_LOCAL_DIRS")
    return tempfile.TemporaryFile(dir=disks.split(",")[0] if disks else None)


class Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes):
        self.label, self.children, self.terminal = label, {}, None


class Terminal:
    """What is known of one text: its owner, how many rows have it, and the names under which parts of them go."""

    __slots__ = ("owner", "row", "rows", "names")

    def __init__(self):
        self.owner, self.row, self.rows, self.names = None, None, 0, []

    def add(self, owner: int | None, row: int, rows: int, names: list[int], better: Callable[[int, int], bool]) -> None:
        if self.row is None:
            self.owner, self.row = owner, row
        elif owner is not None and (self.owner is None or better(owner, self.owner)):
            self.owner, self.row = owner, row
        elif owner == self.owner and row < self.row:
            self.row = row
        self.rows += rows
        self.names.extend(names)


class Trie:
    """A compressed radix trie over byte strings that all start with ``prefix``.

    Above ``budget`` label bytes the heaviest subtree under the root moves to a file of the task beside Spark's own
    spills, which goes with the task; what belongs there is appended to it from then on. ``drain`` replays each such file into
    a trie of its own, rooted at the file's longest common start, so every replay splits what it reads.
    """

    def __init__(self, better: Callable[[int, int], bool], budget: int = BUDGET, prefix: bytes = b""):
        self.better, self.budget, self.prefix, self.skip = better, budget, prefix, len(prefix)
        self.root, self.weight, self.files = Node(b""), {}, {}

    @property
    def size(self) -> int:
        return sum(self.weight.values())

    def terminal(self, key: bytes) -> Terminal:
        node, at, first = self.root, self.skip, key[self.skip:self.skip + 1]
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.weight[first] = self.weight.get(first, 0) + len(child.label) + 200
                at = len(key)
            elif key.startswith(child.label, at):
                at += len(child.label)
            else:
                n = _common(child.label, key, at)
                middle = node.children[key[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                child, at = middle, at + n
            node = child
        if node.terminal is None:
            node.terminal = Terminal()
        return node.terminal

    def add(self, key: bytes, owner: int | None, row: int, rows: int, names: list[int]) -> Terminal | None:
        first = key[self.skip:self.skip + 1]
        if first in self.files:
            pickle.dump((key, owner, row, rows, names), self.files[first])
            return None
        terminal = self.terminal(key)
        terminal.add(owner, row, rows, names, self.better)
        return terminal

    def spill(self) -> None:
        """Move the heaviest subtrees of more than one text to files until the rest is within the budget."""
        while self.size > self.budget:
            several = [first for first in self.weight if self.root.children[first[0]].children]
            if not several:
                return  # what is left are single texts, one for each first byte
            first = max(several, key=self.weight.get)
            child = self.root.children[first[0]]
            self.files[first] = _scratch_file()
            for key, t in self._walk(child):
                pickle.dump((key, t.owner, t.row, t.rows, t.names), self.files[first])
            del self.root.children[first[0]], self.weight[first]

    def _walk(self, top: Node) -> Iterator[tuple[bytes, Terminal]]:
        """The texts below ``top``."""
        stack = [(top, self.prefix)]
        while stack:
            node, before = stack.pop()
            path = before + node.label
            if node.terminal is not None:
                yield path, node.terminal
            stack.extend((c, path) for c in node.children.values())

    def drain(self) -> Iterator[tuple[bytes, Terminal]]:
        """Every text with its terminal, each text once."""
        yield from self._walk(self.root)
        self.root, self.weight = Node(b""), {}
        for file in self.files.values():
            start = None
            for key, *_ in _records(file):
                start = key if start is None else start[:_common(start, key, 0)]
            inner = Trie(self.better, self.budget, start)
            for key, *entry in _records(file):
                inner.add(key, *entry)
                if inner.size > inner.budget:
                    inner.spill()
            file.close()
            yield from inner.drain()


def _records(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _larger(a: int, b: int) -> bool:
    return a > b


def _smaller(a: int, b: int) -> bool:
    return a < b


KEEP = {"largest": _larger, "smallest": _smaller}


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches with the number of their first row; numbers never repeat between partitions."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield batch, row
        row += batch.num_rows


def _members(keep: str, budget: int):
    """Each row with the name of its text in this partition: the number of the first row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(KEEP[keep], budget)
        for batch, row in _numbered(batches):
            names = []
            for i, key in enumerate(batch.column(1).to_pylist()):
                terminal = trie.terminal(key)
                if not terminal.names:
                    terminal.names.append(row + i)
                names.append(terminal.names[0])
                if trie.size > budget:
                    trie = Trie(KEEP[keep], budget)
            numbers = pa.array(range(row, row + batch.num_rows), pa.int64())
            rest = batch.drop_columns([batch.schema.names[1]])
            columns = [*rest.columns, numbers, pa.array(names, pa.int64())]
            yield pa.record_batch(columns, names=[*rest.schema.names, "row_no", "name"])

    return run


def _texts(keep: str, budget: int):
    """The texts of this partition, each once for every trie it fills, with owner and number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(KEEP[keep], budget)
        for batch, row in _numbered(batches):
            for i, (owner, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                terminal = trie.terminal(key)
                terminal.add(owner, row + i, 1, [] if terminal.names else [row + i], trie.better)
                if trie.size > budget:
                    yield from _batches(trie.drain(), _local)
                    trie = Trie(KEEP[keep], budget)
        yield from _batches(trie.drain(), _local)

    return run


def _merge(keep: str, budget: int):
    """Owner and size of each text over all partitions, once for each name it goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(KEEP[keep], budget)
        for batch in batches:
            for text, owner, row, rows, name in zip(*[c.to_pylist() for c in batch.columns]):
                trie.add(text, owner, row, rows, [name])
                if trie.size > budget:
                    trie.spill()
        yield from _batches(trie.drain(), _resolved)

    return run


LOCAL = "text binary, owner long, row long, rows long, name long"
RESOLVED = "name long, keep_id long, keep_row long, group_size long, text_sha256 string"


def _local(text: bytes, t: Terminal) -> list[tuple]:
    return [(text, t.owner, t.row, t.rows, t.names[0])]


def _resolved(text: bytes, t: Terminal) -> list[tuple]:
    digest = sha256(text).hexdigest()
    return [(name, t.owner, t.row, t.rows, digest) for name in t.names]


ARROW = {
    _local: pa.schema([("text", pa.binary()), *[(c, pa.int64()) for c in ("owner", "row", "rows", "name")]]),
    _resolved: pa.schema([
        *[(c, pa.int64()) for c in ("name", "keep_id", "keep_row", "group_size")], ("text_sha256", pa.string()),
    ]),
}


def _batches(found: Iterator[tuple[bytes, Terminal]], rows_of: Callable) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and bytes."""
    rows, held = [], 0
    for text, t in found:
        rows.extend(rows_of(text, t))
        held += len(text)
        if len(rows) >= OUT or held > 8 << 20:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW[rows_of])], schema=ARROW[rows_of])
            rows, held = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW[rows_of])], schema=ARROW[rows_of])


def owners(
    docs: DataFrame,
    keep: str = "largest",
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_rows: bool = False,
    budget: int = BUDGET,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of ``docs``; texts are equal if their bytes are.

    ``keep`` says which id owns a text, "largest" or "smallest". Partitions of the table first merge their own copies in
    a trie, so however often a text occurs, it is shuffled once a partition at most; texts then meet by length and
    content hash in tries that see all of them. Rows learn their owner by the name their partition gave the text, a key
    no partition shares, so a text that makes up much of the table is spread like any other.

    Null counts as the empty text. Null ids own a text only where all its ids are null. Of rows that repeat both text
    and owning id, one is kept. An empty table gives no rows. With ``whole_rows`` the columns of ``docs`` come as one
    struct ``document`` in place of the id, whatever their names. ``docs`` is read twice and must give the same
    partitions both times, as a table read from files does.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    columns = [F.col(id_col).cast("long").alias("id"), text]
    schema = "id long, row_no long, name long"
    if whole_rows:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
        kind = docs.select(columns[-1]).schema["document"].dataType.simpleString()
        schema = f"id long, document {kind}, row_no long, name long"
    source = docs.select(*columns)
    members = source.mapInArrow(_members(keep, budget), schema)
    texts = source.mapInArrow(_texts(keep, budget), LOCAL)
    dealt = texts.repartition(F.octet_length("text"), F.xxhash64("text"))
    resolved = dealt.mapInArrow(_merge(keep, budget), RESOLVED)
    named = members.join(resolved, "name")
    what = "document" if whole_rows else F.col("id").alias(id_col)
    return named.select(what, "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text."""
    return owners(docs, keep, id_col, text_col, whole_rows=True).where("kept").select("document.*")
