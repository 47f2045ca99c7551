import numpy as np
import pyarrow as pa
import pytest

from weft.llm.buckets import answered, pack, totals
from weft.llm.near_dedup import idf


@pytest.mark.parametrize("more", [0, 1, 2])
def test_counts_beyond_32_bits(more):
    """A string that is nearly everywhere must not come out as one that occurs never or once, nor as a rare shingle."""
    keys = np.array([3, 8], np.uint64)
    half = np.array([1 << 31, 1], np.uint32).tobytes()
    other = np.array([(1 << 31) + more, 0], np.uint32).tobytes()
    found = totals(pa.table({"part": [0, 0], "bucket": [0, 1], "keys": pa.array([pack(keys), pack(keys)], pa.binary()), "counts": pa.array([half, other], pa.binary())}))
    for bucket in (0, 1):
        counts = answered(found.filter(pa.compute.equal(found.column("bucket"), bucket)))
        assert counts[0] > 1 and counts[0] == pytest.approx(2**32 + more) and counts[1] == 1
    everywhere = idf(np.array([2.0**32 + more, 2.0**31, 1], np.float32), 2**33)
    assert everywhere[0] < everywhere[1] < everywhere[2]
