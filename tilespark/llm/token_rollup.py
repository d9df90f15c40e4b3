"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change is an insert, a delete or a revision of one document's count; it turns into
signed rows (revision: the old count with sign -1 under the old key, the new one with
sign +1 under the new key). A batch of changes is summed by key and becomes one folder
of additive deltas, named by the batch. Totals are the sums over the folders whose
batch has a commit mark. The mark is written last, in one step, and names the attempt
whose rows count; a batch that has a mark is not applied again, and rows of an attempt
that was lost on the way are never read. Compaction replaces the folders of many batches by one
of their totals, named in a numbered manifest that appears in one step as well.

Tokenizers are SQL patterns that match a token, under a versioned name, so the counts
are plain columns; ``bpe_counts`` counts with a public byte-pair vocabulary instead.

Defined cases: null text counts as empty; null source or language is a key of its own;
a null op, or one that is not insert, delete or revise, fails the batch; keys whose
totals are zero stay listed; repeated rows in one batch count as often as they occur; very
long texts are counted whole; an empty batch is committed and changes nothing; a rollup
without batches has no totals and can be compacted; columns of changes that are not named
below are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm.common import received, send

#: Version name -> Java regex of one token.
TOKENIZERS = {
    "words@1": r"[^\x20\x09-\x0D]+",
    "words@2": r"[0-9A-Za-z]+|[^\x00-\x7F]+",
    "pieces@1": r"[0-9]|[A-Za-z]+|[^\x00-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]",
}
KEY = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, batch string, attempt string"


def token_count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def bpe_counts(texts: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``texts`` with a column tokens, by a byte-pair vocabulary file (base64 token and rank a line).

    Spark reads the file, whose size bounds what is broadcast; a null text has no tokens; a
    column of that name, in any case, is replaced.
    """
    texts = texts.select(*[texts[f"`{c}`"] for c in texts.columns if c.lower() != "tokens"])
    spark = texts.sparkSession
    ranks = {base64.b64decode(a): int(b) for a, b in (r["value"].split() for r in spark.read.text(vocabulary).toLocalIterator() if r["value"])}
    sent, names = send(spark, (ranks, pattern)), texts.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import tiktoken

        own, split = received(sent)
        encoding = tiktoken.Encoding("rollup", pat_str=split, mergeable_ranks=own, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t or "")) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*names, "tokens"])

    from pyspark.sql import types as T

    return texts.mapInArrow(counted, T.StructType([*texts.schema.fields, T.StructField("tokens", T.LongType())]))


def signed(changes: DataFrame) -> DataFrame:
    """Additive deltas of changes.

    ``changes``: op, source, lang, tokenizer, tokens, and for revisions old_source,
    old_lang, old_tokenizer, old_tokens. Sums are taken before the shuffle too, so a
    source with most rows is a few rows of each task by then.
    """
    new = F.struct(*[F.col(c).alias(c) for c in KEY], F.lit(1).alias("docs"), F.col("tokens").alias("tokens"))
    gone = F.struct(*[F.col(c).alias(c) for c in KEY], F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"))
    old = F.struct(*[F.col(f"old_{c}").alias(c) for c in KEY], F.lit(-1).alias("docs"), (-F.col("old_tokens")).alias("tokens"))
    rows = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(old, new))
    rows = rows.otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))).cast("array<struct<source:string,lang:string,tokenizer:string,docs:int,tokens:bigint>>"))
    return changes.select(F.inline(rows)).groupBy(*KEY).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))


class Rollup:
    """Additive totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _publish(self, text: str, name: str) -> bool:
        """A small file that appears whole or not at all; False if there is one: of two writers one rename wins."""
        draft, place = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(name)
        out = self._files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._files.mkdirs(place.getParent())
        if self._files.exists(place) or not self._files.rename(draft, place):
            self._files.delete(draft, False)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if it had been applied before."""
        mark = f"commits/{base64.urlsafe_b64encode(batch.encode()).decode()}"
        if self._files.exists(self._at(mark)):
            return False
        attempt = uuid.uuid4().hex
        signed(changes).withColumn("batch", F.lit(batch)).withColumn("attempt", F.lit(attempt)).write.parquet(f"{self.path}/deltas/{attempt}")
        return self._publish(attempt, mark)

    def _names(self, folder: str) -> list[str]:
        if not self._files.exists(self._at(folder)):
            return []
        return sorted(m.getPath().getName() for m in self._files.listStatus(self._at(folder)))

    def _text(self, name: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}").toLocalIterator())

    def _live(self) -> tuple[int, list[str], list[str]]:
        """Number of the newest manifest (0: none), the attempts that count, and all marks they stand for.

        A manifest is the attempt that holds the totals of some batches, and their marks.
        One short string for each committed batch comes to the driver.
        """
        numbers = self._names("manifests")
        base, *covered = self._text(f"manifests/{numbers[-1]}").split("\n") if numbers else [""]
        known = set(covered)
        marks = [m for m in self._names("commits") if m not in known]
        attempts = [self._text(f"commits/{m}") for m in marks]
        return int(numbers[-1]) if numbers else 0, [*([base] if base else []), *attempts], [*covered, *marks]

    def _sum(self, attempts: list[str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{a}" for a in attempts]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEY).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens over all committed batches."""
        return self._sum(self._live()[1])

    def compact(self) -> bool:
        """Write the totals of the batches so far as one attempt; False if another compaction came first.

        The manifest that names the attempt and the batches appears by one rename, after
        the rows. Marks are never touched: until then the old ones count, and a batch
        that is committed meanwhile is not in the manifest and counts by its own mark.
        """
        number, attempts, marks = self._live()
        attempt = uuid.uuid4().hex
        self._sum(attempts).withColumn("batch", F.lit(None).cast("string")).withColumn("attempt", F.lit(attempt)).write.parquet(f"{self.path}/deltas/{attempt}")
        return self._publish("\n".join([attempt, *marks]), f"manifests/{number + 1:012d}")
