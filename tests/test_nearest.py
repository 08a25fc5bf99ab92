from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quillstone import catalogue
from quillstone.operators import nearest


def brute(q, v, ids, k, digits):
    out = {}
    for i, x in q:
        s = [(-round(sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5), digits), n) for y, n in zip(v, ids) if len(x) == len(y) and any(x) and any(y)]
        out[i] = [n for _, n in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("kind", [int, lambda n: f"id{n:05d}"])
def test_equals_brute_force(monkeypatch, kind):
    for name, value in (("HELD", 20_000), ("ROWS", 4), ("COLUMNS", 16)):
        monkeypatch.setattr(nearest, name, value)
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 6)).astype(np.float32).astype(float)
    v[r.integers(0, 400, 150)] = v[7]  # a large group of copies
    v[20:40] = v[40:60] * 2  # one direction, many lengths
    v = [x.tolist() for x in v] + [[0.0] * 6, [1.0, 2.0]]
    ids = [kind(n) for n in r.permutation(len(v)).tolist()]
    q = [(i, v[i]) for i in (0, 3, 7, 25, 45, 401)] + [(900, v[7]), (901, [0.0] * 6)]
    asked = SimpleNamespace(value=nearest.Asked.of(pa.table({"query_id": [i for i, _ in q], "v": [x for _, x in q]})))
    t = pa.table({"id": ids, "v": v})
    got = pa.Table.from_batches(nearest.best(asked, 5, 9)(t.to_batches(max_chunksize=50))).to_pandas().sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    got["rank"] = got.groupby("query_id").cumcount() + 1
    named = pa.Table.from_batches(nearest.named(asked)([pa.RecordBatch.from_pandas(got[["query_id", "id", "rank", "score"]], preserve_index=False)])).to_pandas()
    have = {i: g.sort_values("rank")["id"].tolist() for i, g in named.groupby("query_id")}
    assert have == {i: x for i, x in brute(q, v, ids, 5, 9).items() if x}


def test_scores_that_round_alike_are_ties(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1e-5], 0), (2, [1.0, 5e-6], 0)]  # cosines 1 - 5e-11 and 1 - 1.25e-11
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.id for r in catalogue.dense_topk(spark, str(tmp_path)).orderBy("rank").collect()] == [0, 1, 2]
