"""The substring operators with many groups and hot anchors: a passage that a third of all documents share, copies, repeated rows."""

import numpy as np
import pytest
from test_llm import cut

from lumenframe.llm import suffix_arrays, suffix_automata


def texts():
    r = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(words[i] for i in r.integers(0, 400, n))
    passage, other = prose(60), prose(90)
    rows = [(k, f"{prose(r.integers(5, 40))} {passage} {prose(r.integers(5, 40))}") for k in range(0, 120, 3)]
    rows += [(k, f"{prose(70)} {other[k:]} {prose(3)}") for k in range(1, 60, 3)] + [(k, prose(80)) for k in range(2, 60, 3)]
    rows += [(200 + k, rows[k][1]) for k in range(25)] + [(None, rows[0][1]), (201, rows[1][1]), (300, None), (301, "")]
    return rows


@pytest.mark.parametrize("hot", [1 << 30, 3, 0])
@pytest.mark.parametrize("kind, split", [(suffix_arrays.ByteRepeats, lambda t: t), (suffix_automata.WordRepeats, lambda t: t.split())])
def test_against_brute_force(spark, kind, split, hot):
    rows = texts()
    got = kind(hot_groups=hot).run(spark.createDataFrame(rows, "doc_id long, text string"), "t", group_mb=0.002).collect()
    want = cut([(d, (t or "").encode()) for d, t in rows], split, 50)
    assert len(got) == len(rows) and {r.doc_id: (r.n, bytes(r.kept)) for r in got} == want
    assert any(r.spans for r in got)


def test_hot_windows_of_one_document_are_not_sent():
    """A line of 43 bytes that all documents have, shorter than a window, in prose of its own: nothing is repeated, so no group sends a context."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    op, line = suffix_arrays.ByteRepeats(hot_groups=3), b"a line that each has, shorter than a window"
    prose = lambda: bytes(r.integers(97, 123, 200).astype(np.uint8))
    groups = [pa.table({"doc_id": pa.array([b]), "th": pa.array([b]), "b": pa.array([b]), "text": pa.array([(prose() + line + prose()).decode()])}) for b in range(8)]
    sent = pa.Table.from_batches([m for g in groups for m in op.sent_keys(1)([g.to_batches()[0]])])
    shared = op.shared_keys()(sent)
    assert shared.num_rows == 8 and all(len(x) for x in shared["hot"].to_pylist())
    by = lambda t, b: t.filter(pa.array([x == b for x in t["b"].to_pylist()]))
    again = op.shared_keys()(pa.concat_tables([op.sent_windows(1)(g, by(shared, b)) for b, g in enumerate(groups)]))
    assert again.num_rows == 0
    empty = pa.array([b""] * shared.num_rows, pa.binary())
    for b, g in enumerate(groups):
        assert op.contexts(1, 1)(g, by(shared.append_column("single", empty), b)).num_rows == 0


def test_kasai_against_plain_comparison():
    r = np.random.default_rng(2)
    for n in (1, 2, 9, 40, 700):
        text = r.integers(97, 99, n).astype(np.uint8)
        first = suffix_arrays.eights(text)
        sa = suffix_arrays.suffix_array(first)
        raw = text.tobytes()
        assert [raw[i:] for i in sa] == sorted(raw[i:] for i in range(n))
        want = [0] + [next((k for k in range(50) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or a + k >= n or b + k >= n), 50) for a, b in zip(sa, sa[1:], strict=False)]
        assert suffix_arrays.common_prefixes(sa, first, 50, stride=5).tolist() == want
