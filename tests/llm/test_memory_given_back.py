"""Workers give free memory back before they begin a task."""

import pyarrow as pa

from sheaf.llm import common


def test_free_memory_is_given_back_before_a_task_begins(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "tidy", lambda: calls.append("tidy"))
    rows = common.slices(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["text"])]), "text")
    assert next(rows).num_rows == 2
    assert calls == ["tidy"]
