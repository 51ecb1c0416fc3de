"""Tasks take long batches in slices, with the rows of the whole batch."""

import pyarrow as pa
import pytest

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import neardup  # noqa: E402


def test_a_long_batch_is_taken_in_slices():
    texts = [None, "", *(" ".join(f"w{i}x{j % (50 + i)}" for j in range(30_000)) for i in range(38))]
    batch = pa.record_batch({"doc_id": range(40), "text": pa.array(texts, pa.string())})
    assert batch.nbytes > 6 << 20
    out = list(neardup._sign(iter([batch])))
    assert len(out) > 2
    alone = [b for i in range(40) for b in neardup._sign(iter([batch.slice(i, 1)]))]
    assert pa.Table.from_batches(out).to_pylist() == pa.Table.from_batches(alone).to_pylist()
    assert not list(neardup._sign(iter([batch.slice(0, 0)])))
