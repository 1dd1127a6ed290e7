"""Streams with state by key against the same rows in one piece, over several batches, with restarts."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import drop_repeated_sentences
from weftline.operators.clusters import cluster
from weftline.streaming import keyed


class Fed:
    """A folder of files that a stream reads, and what its batches gave. Each run is a new query from the checkpoint."""

    def __init__(self, spark, root, schema, flow, out, made=None, mode="append"):
        self.spark, self.root, self.schema, self.flow, self.out, self.made, self.mode = spark, root, schema, flow, out, made, mode

    def run(self, rows=None):
        if rows is not None:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.root}/in")
        keyed.write_batches(self.flow(stream), f"file://{self.root}/out", f"file://{self.root}/checkpoint", self.made, self.mode).awaitTermination(300)
        return self

    def lose_last_commit(self):
        """As if the machine was lost after the last batch was written and before it was committed."""
        commits = sorted((f for f in (self.root / "checkpoint" / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
        for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
            f.unlink(missing_ok=True)
        return self

    def table(self):
        return keyed.batches(self.spark, f"file://{self.root}/out", self.out)


def _pieces(rows, n):
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


def test_sentences_of_many_documents_over_restarts(spark, tmp_path):
    r = random.Random(5)
    pool = [f"This is common sentence number {i} of them" for i in range(25)]
    rows = []
    for i in range(120):
        own = [f"Only document {i} says this of itself"] + [r.choice(pool) for _ in range(r.randint(0, 6))] + ["short one here"] * (i % 3)
        r.shuffle(own)
        text = "Everybody says this in the first place. " + ". ".join(own) + (". Twice and thrice it says the same" * 4 if i == 40 else "")
        rows.append((i, {50: None, 51: "", 52: "no", 53: "  odd  "}.get(i, text)))
    fed = Fed(spark, tmp_path, "doc_id long, text string", lambda s: keyed.seen_sentences(s, "doc_id", "text"), "id long, text string", keyed.whole_texts, "update")
    for k, piece in enumerate(_pieces(rows, 3)):
        fed.run(piece)
        if k == 1:
            fed.lose_last_commit().run()
    want = drop_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", "doc_id")
    got = {x["id"]: x["text"] for x in fed.table().collect()}
    assert got == {x["doc_id"]: x["text"] for x in want.collect()}
    assert fed.table().count() == len(rows) and fed.table().select("batch").distinct().count() == 3


def _requests(seed):
    r, t, rows = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(300):
        # Some gaps are longer than what a late row may be late by, so that state is dropped on the way.
        t += r.choice([0, 1, 5_000_000, 20_000_000, 60_000_000] + [400_000_000] * (i % 50 == 0))
        rows.append((i, r.choice(["a", "a", "a", "b", None]), t, r.choice(["ok", "HTTP 429", "was Blocked", None])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_tokens_and_cool_downs_over_restarts(spark, tmp_path, seed):
    rows = _requests(seed)
    want, state = {}, {}
    for i, k, t, _ in rows:
        begin, used = state.get(k, (t, 0))
        if t > begin + 60_000_000:
            begin, used = t, 0
        elif used == 2:
            begin, used = begin + 60_000_000, 0
        state[k] = (begin, used + 1)
        want[i] = (max(t, begin) - t) / 1e6
    skipped, until = {}, {}
    for i, k, t, m in rows:
        skipped[i] = t <= until.get(k, 0)
        if not skipped[i] and m and ("429" in m or "blocked" in m.lower()):
            until[k] = t + 45_000_000
    schema = "id long, k string, us long, message string"
    timed = lambda s: s.withColumn("ts", F.timestamp_micros("us"))
    tokens = Fed(spark, tmp_path / "a", schema, lambda s: keyed.granted(timed(s), "k", "ts", "id", 2, 60.0, "5 minutes"), "k string, id long, granted timestamp, waited double")
    cool = Fed(spark, tmp_path / "b", schema, lambda s: keyed.cooled(timed(s), "k", "ts", "id", "message", 45, "5 minutes"), "k string, id long, skipped boolean")
    for n, piece in enumerate(_pieces(rows, 3)):
        r = random.Random(n)
        r.shuffle(piece)
        tokens.run(piece)
        cool.run(piece)
        if n == 1:
            tokens.lose_last_commit().run()
    got = tokens.table().collect()
    assert len(got) == len(rows) and {x["id"]: x["waited"] for x in got} == want
    got = cool.table().collect()
    assert len(got) == len(rows) and {x["id"]: x["skipped"] for x in got} == skipped
    assert any(want.values()) and any(skipped.values())


def test_late_rows_join_the_leaders_of_earlier_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, 1000 + i, r.choice(["hot"] * 20 + [f"u{j}" for j in range(40)] + [None])) for i in range(300)]
    fed = Fed(spark, tmp_path, "queue_id long, dataset_url_id long, url string", lambda s: keyed.led(s, F.col("url")), "place long, role string, primary long", keyed.roles)
    for k, piece in enumerate(_pieces(rows, 3)):
        fed.run(piece)
        if k == 1:
            fed.lose_last_commit().run()
    want = cluster(spark.createDataFrame(rows, "queue_id long, dataset_url_id long, url string"), [F.col("url")], "queue_id", "dataset_url_id")
    got = {x["place"]: (x["role"], x["primary"]) for x in keyed.latest_roles(fed.table()).collect()}
    assert got == {x["queue_id"]: (x["role"], x["primary"]) for x in want.collect()}
    # Some rows had been alone when they came.
    assert fed.table().groupBy("place").count().where("count > 1").count() > 0
