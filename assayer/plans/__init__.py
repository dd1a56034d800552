"""Query catalogue; importing this package registers every query."""

from assayer.plans import comparison, conversations, data_in_out, decision_support, evaluation, generation, patterns, relational, streams, synthesis, tasks  # noqa: F401
