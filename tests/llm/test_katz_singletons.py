import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from harborline.llm import katz_model, queries
from harborline.llm.common import LARGE_ROWS, crc_of_id, stored
from tests.llm.test_token_operators import brute_katz


def test_the_query_keeps_pairs_seen_once(spark, rows, tmp_path):
    """The query's scores, and not only those of the settings, are those of a model with every pair."""
    some = [(100 + i, r[1]) for i, r in enumerate(rows) if len(r[1] or "") < 5000]
    df = spark.createDataFrame(some, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["held"] for r in df.select("doc_id", (crc_of_id("doc_id") % 10 == 0).alias("held")).collect()}
    held = [out[i] for i, _ in some]
    assert any(held) and not all(held)
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_katz_backoff"](spark, str(tmp_path)).collect()}
    want, prob, c = brute_katz(some, held, least=1)
    for doc, h, n, known, train, base, score in want:
        assert (got[doc]["held_out"], got[doc]["n_tokens"], got[doc]["n_known"]) == (h, n, known)
        assert np.isclose(got[doc]["score"], score)
    for u in ("<s>", "one", next(iter(c))):
        assert np.isclose(sum(prob(u, w) for w in [*c, "never seen"]), 1)


def test_a_singleton_is_discounted_and_not_dropped(spark):
    """One pair seen once among many seen twice: its score is its own, not the backoff's."""
    rows = [(i, f"w{i % 40} v{i % 40}") for i in range(80)] + [(100 + i, f"w{i} x{i}") for i in range(60)] + [(999, "w3 x3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") == 999
    want, *_ = brute_katz(rows, [i == 999 for i, _ in rows], least=1)
    score = {k: katz_model.katz_scores(df, held, katz_model.Settings(least=k)).filter("doc_id = 999").first()["score"] for k in (1, 2)}
    assert np.isclose(score[1], want[-1][-1]) and score[1] > score[2]


def test_a_block_without_a_pair_of_its_own(spark):
    """A block of copies alone owns no pair, as those before it asked for all of them."""
    rows = [(i, f"w{i % 40} v{i % 40}") for i in range(4200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want, *_ = brute_katz(rows, [i % 10 == 0 for i, _ in rows], least=1)
    got = {r["doc_id"]: r["score"] for r in katz_model.katz_scores(df, F.col("doc_id") % 10 == 0).collect()}
    assert len(got) == len(rows) and all(np.isclose(got[w[0]], w[-1]) for w in want)


def test_parts_grow_with_the_table(spark, rows, monkeypatch):
    """However few the shuffle partitions are, a task holds a bounded part; the scores stay."""
    some = [(100 + i, r[1]) for i, r in enumerate(rows)]
    df, held = spark.createDataFrame(some, "doc_id long, text string"), F.col("doc_id") % 3 == 0
    kept = {}

    def keep(table, label, *options):
        kept[label] = stored(table, label, *options)
        return kept[label]

    monkeypatch.setattr(katz_model, "stored", keep)
    monkeypatch.setattr(katz_model, "PART_BYTES", 1 << 10)
    got = {r["doc_id"]: r["score"] for r in katz_model.katz_scores(df, held).collect()}
    assert kept["answered"].select("part").distinct().count() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    want, *_ = brute_katz(some, [i % 3 == 0 for i, _ in some], least=1)
    assert all(np.isclose(got[w[0]], w[-1]) for w in want)


def test_row_groups_of_large_rows_are_small(spark):
    """Sixty rows of a megabyte don't become one row group, which a reader would hold whole."""
    large = F.concat(*[F.randstr(F.lit(8192), F.lit(k)) for k in range(128)])
    table = stored(spark.range(0, 60, 1, 1).withColumn("raw", large.cast("binary")), "large", LARGE_ROWS)
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{table._stored_at.removeprefix('file://')}/*.parquet")]
    assert table.count() == 60 and max(m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)) < 32 << 20
