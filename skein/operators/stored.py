"""An index kept as tables, which queries read only the parts of that their terms need.

terms (bucket, term, df, idf), postings (bucket, term and arrays of key, n, total, dl), notes (key and what is filtered on)
and stats (one row). Terms go to a fixed number of buckets by CRC-32, which are partitions; within a file postings are
sorted by term, so that a query opens its terms' buckets and in them the row groups that hold the terms. A row has a
term's postings in some thousand documents, so that the term stands once for all of them and the keys, in their order,
take a byte or two. The length of a document stands beside each posting, so that BM25 needs no join; the norms of the
cosine are summed on its first use. Bucket -1 has, without a term, the lengths of the documents themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import front_matter, note_type
from skein.operators.index import B, K1, counted, lengths, query_terms
from skein.session import checkpoint, shared_dir
from skein.vocab import STOP_WORDS

#: Buckets of terms, and files that the postings of a bucket are spread over, so that a term held by a third of all
#: documents is written by several tasks.
BUCKETS, FILES = 16, 2
#: Bytes of text whose terms are counted at once; a longer text is counted alone.
CHUNK = 1 << 23


def note_fields(notes: DataFrame, key: str = "doc_id", text: str = "text", stated: str = "note_type", path: str = "path") -> DataFrame:
    """(key, kind, domain, tags, title): what searches filter on, from front matter and path; never null."""
    meta = front_matter(F.col(text))
    get = lambda k: F.try_element_at(meta, F.lit(k))
    blank = lambda c: F.coalesce(c, F.lit(""))
    kind = note_type(F.coalesce(F.nullif(get("type"), F.lit("")), F.col(stated)), F.col(path))
    return notes.select(key, F.coalesce(kind, F.lit("note")).alias("kind"), blank(F.coalesce(get("domain"), get("category"))).alias("domain"), blank(get("tags")).alias("tags"), F.coalesce(get("title"), F.regexp_extract(path, r"([^/]+?)(?:\.md)?$", 1), F.lit("")).alias("title"))


def _blocks(terms: pa.Array, starts, *values) -> pa.RecordBatch:
    """A row for each term, with its part of each of the values; the parts begin at ``starts``, which ends with their end."""
    import numpy as np

    offsets = pa.array(np.asarray(starts, dtype="int32"))
    return pa.RecordBatch.from_arrays([terms, *(pa.ListArray.from_arrays(offsets, v) for v in values)], names=["term", "key", "n", "total", "dl"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (key, text in lower case), each key once and no text null: blocks of each term, and one of the lengths.

    Terms are the runs of ASCII letters and digits, as those of ``tokens``.
    """
    import numpy as np

    plain = np.zeros(256, dtype=bool)
    plain[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
    stops = pa.array(STOP_WORDS, pa.string())

    def of(part: pa.RecordBatch) -> pa.RecordBatch | None:
        part = part.take(pc.sort_indices(part.column(0)))
        keys, text = part.column(0), part.column(1).cast(pa.large_binary())
        places = np.frombuffer(text.buffers()[1], "int64")[text.offset : text.offset + len(text) + 1]
        chars = np.frombuffer(text.buffers()[2] or b"", "uint8")[places[0] : places[-1]]
        inner = plain[chars]
        # a text's last character and the next one's first don't make one term
        ends = places[1:-1] - places[0]
        cut = np.zeros(len(chars) + 1, dtype=bool)
        cut[ends] = True
        before = np.concatenate([[False], inner[:-1]]) if len(inner) else inner
        first = np.flatnonzero(inner & (~before | cut[:-1]))
        if not len(first):
            return None
        size = np.add.reduceat(inner, first, dtype="int64")
        offsets = np.concatenate([[0], np.cumsum(size)]).astype("int32")
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(chars[inner])).dictionary_encode()
        terms, codes = words.dictionary, words.indices.to_numpy()
        wanted = pc.and_(pc.greater(pc.binary_length(terms), 1), pc.invert(pc.is_in(terms, value_set=stops))).to_numpy(zero_copy_only=False)
        rows = np.searchsorted(places - places[0], first, side="right") - 1
        kept = wanted[codes]
        pairs, n = np.unique(codes[kept].astype("int64") * len(keys) + rows[kept], return_counts=True)
        if not len(pairs):
            return None
        code, row = np.divmod(pairs, len(keys))
        total, least = np.bincount(row, weights=n, minlength=len(keys)).astype("int32"), np.full(len(keys), np.iinfo("int64").max)
        np.minimum.at(least, row, n)
        held = np.flatnonzero(total)
        dl = np.zeros(len(keys), dtype="int32")
        dl[held] = np.rint(1 / (least[held] / total[held]))
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        row, n = np.concatenate([row, held]), np.concatenate([n, total[held]])
        named = pa.concat_arrays([terms.take(pa.array(code[starts[:-1]])), pa.nulls(1, pa.string())])
        return _blocks(named, [*starts, len(row)], keys.take(pa.array(row)), pa.array(n, pa.int64()), pa.array(total[row]), pa.array(dl[row]))

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
            if (found := of(batch.slice(at, to - at))) is not None:
                yield found
            at = to


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the terms of (term, key, n, total, dl)."""
    import numpy as np

    for batch in batches:
        if batch.num_rows:
            words = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = words.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            code = codes[order]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
            yield _blocks(words.dictionary.take(pa.array(code[starts[:-1]])), starts, *(c.take(pa.array(order)) for c in batch.columns[1:]))


def _posted(notes: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, n, total, dl): blocks of postings.

    A row whose key comes once is counted where it is read. Only rows of repeated or null keys are shuffled to be summed.
    """
    kind = notes.schema[key].dataType.simpleString()
    schema = f"term STRING, key ARRAY<{kind}>, n ARRAY<BIGINT>, total ARRAY<INT>, dl ARRAY<INT>"
    own = notes.select(F.col(key).alias("key"), text.alias("text")).where("text is not null")
    count = lambda d: d.select("key", F.lower("text").alias("text")).mapInArrow(_count, schema)
    repeated = own.groupBy("key").agg(F.count("*").alias("times")).where("times > 1 or key is null")
    if repeated.isEmpty():
        return count(own)
    marked = own.join(repeated.withColumnRenamed("key", "again"), F.col("key").eqNullSafe(F.col("again")), "left")
    summed = checkpoint(counted(marked.where("times is not null"), "key"))
    sizes = lengths(summed.withColumn("tf", F.col("n") / F.col("total")), "key").select(F.col("key").alias("of"), F.col("dl").cast("int").alias("dl"))
    each = summed.join(sizes, F.col("key").eqNullSafe(F.col("of"))).select("term", "key", "n", "total", "dl")
    whole = sizes.select(F.lit(None).cast("string").alias("term"), F.col("of").alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("total"), "dl")
    return count(marked.where("times is null")).unionByName(each.unionByName(whole).mapInArrow(_pack, schema))


def build(notes: DataFrame, fields: DataFrame, folder: str, key: str = "doc_id", text: Column | None = None, buckets: int = BUCKETS, files: int = FILES) -> None:
    """Write the index of ``notes`` below ``folder``, in place of the one there. fields: a row for each key, as of note_fields.

    Null or empty texts are counted as documents but have no postings.
    """
    total, spark = notes.count(), notes.sparkSession
    bucket = F.coalesce(F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(buckets)).cast("int"), F.lit(-1)).alias("bucket")
    own = _posted(notes, key, F.col("text") if text is None else text).select(bucket, "term", F.size("key").alias("held"), "key", "n", "total", "dl")
    spread = own.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.element_at("key", 1)), F.lit(files)))
    # keys in order are stored as differences
    packed = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#key.list.element": "false"}
    spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").options(**packed).parquet(f"{folder}/postings")
    index = Index(spark, folder, key, 0.0, total, buckets, notes.schema[key].dataType.simpleString())
    # the rows of a bucket are with one task already, so that terms are summed there
    held = index.table("postings").where("bucket >= 0").select("bucket", "term", "held").repartition("bucket")
    terms = held.groupBy("bucket", "term").agg(F.sum("held").alias("df")).withColumn("idf", F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)
    terms.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    fields.write.mode("overwrite").parquet(f"{folder}/notes")
    sizes = index.table("postings").where("bucket = -1").select(F.explode("dl").alias("dl"))
    stats = sizes.agg(F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"), F.count("*").alias("held")).withColumn("n_docs", F.lit(total)).withColumn("buckets", F.lit(buckets))
    # the table whose presence says that the index is whole
    stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")


@dataclass
class Index:
    """A stored index, open for queries."""

    spark: SparkSession
    folder: str
    key: str
    avg_dl: float
    n_docs: int
    buckets: int
    key_type: str
    _tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """One of the tables; its files are listed once."""
        if name not in self._tables:
            # partitioned tables without rows have no file to tell their columns
            own = {"postings": f"term STRING, held INT, key ARRAY<{self.key_type}>, n ARRAY<BIGINT>, total ARRAY<INT>, dl ARRAY<INT>, bucket INT", "terms": "term STRING, df BIGINT, idf DOUBLE, bucket INT"}
            reader = self.spark.read.schema(own[name]) if name in own else self.spark.read
            self._tables[name] = reader.parquet(f"{self.folder}/{name}")
        return self._tables[name]

    def of_terms(self, name: str, terms: list[str]) -> DataFrame:
        places = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.table(name).where(F.col("bucket").isin(places or [-1]) & F.col("term").isin(terms or [""])).drop("bucket")

    def each(self, blocks: DataFrame) -> DataFrame:
        """(term, key, tf, dl): the postings of blocks, one by one."""
        own = blocks.select("term", F.inline(F.arrays_zip("key", "n", "total", "dl"))).where("key is not null")
        return own.select("term", F.col("key").alias(self.key), (F.col("n") / F.col("total")).alias("tf"), "dl")

    def norms(self) -> DataFrame:
        """(key, norm): lengths of the documents' tf-idf vectors, summed once for all cosines of this object."""
        if "norms" not in self._tables:
            known = self.table("terms").select("term", "idf")
            own = self.table("postings").where("bucket >= 0").select("term", "key", "n", "total").join(known, "term")
            each = own.select("idf", F.inline(F.arrays_zip("key", "n", "total"))).where("key is not null")
            w = F.col("n") / F.col("total") * F.col("idf")
            self._tables["norms"] = checkpoint(each.groupBy(F.col("key").alias(self.key)).agg(F.sqrt(F.sum(w * w)).alias("norm")))
        return self._tables["norms"]

    def passing(self, found: DataFrame, kind: str | None, domain: str | None, tags: str | None) -> DataFrame:
        """The rows whose document's fields hold the given substrings, without regard to case; nothing given: all rows."""
        asked = {"kind": kind, "domain": domain, "tags": tags}
        kept = self.table("notes")
        for field, part in asked.items():
            if part is not None:
                kept = kept.where(F.contains(F.lower(field), F.lit(part.lower())))
        return found if all(p is None for p in asked.values()) else found.join(kept.select(self.key), self.key, "left_semi")

    def bm25(self, query: str, kind: str | None = None, domain: str | None = None, tags: str | None = None) -> DataFrame:
        """(key, score) of the documents that pass and hold a term of the query; a term that the query repeats counts as often.

        A query without terms gives no rows. Statistics are those of all documents.
        """
        asked = query_terms(query)
        hits = self.passing(self.each(self.of_terms("postings", asked)), kind, domain, tags)
        # at most a row for each term of the query
        known = F.broadcast(self.of_terms("terms", asked).select("term", "idf"))
        times = F.element_at(F.create_map(*(F.lit(x) for t in dict.fromkeys(asked or [""]) for x in (t, asked.count(t)))), F.col("term"))
        raw = F.col("tf") * F.col("dl")
        score = times * F.col("idf") * raw * (K1 + 1) / (raw + K1 * (1 - B + B * F.col("dl") / F.lit(self.avg_dl)))
        return hits.join(known, "term").groupBy(self.key).agg(F.sum(score).alias("score")).where("score > 0")

    def cosine(self, query: str, kind: str | None = None, domain: str | None = None, tags: str | None = None) -> DataFrame:
        """(key, score): cosine of the query's and the documents' tf-idf vectors, over documents that pass and share a term."""
        asked = query_terms(query)
        hits = self.passing(self.each(self.of_terms("postings", asked)), kind, domain, tags)
        # at most a row for each term of the query
        known = self.of_terms("terms", asked).select("term", "idf")
        share = F.element_at(F.create_map(*(F.lit(x) for t in dict.fromkeys(asked or [""]) for x in (t, asked.count(t) / max(1, len(asked))))), F.col("term"))
        own = known.withColumn("q", share * F.col("idf"))
        norm = own.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
        scored = hits.join(F.broadcast(own), "term").groupBy(self.key).agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot"))
        return scored.where("dot > 0").join(self.norms(), self.key).crossJoin(F.broadcast(norm)).select(self.key, (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score"))  # norm is one row


def open_index(spark: SparkSession, folder: str, key: str = "doc_id") -> Index:
    row = spark.read.parquet(f"{folder}/stats").head()
    kind = spark.read.parquet(f"{folder}/notes").schema[key].dataType.simpleString()
    return Index(spark, folder, key, row["avg_dl"], row["n_docs"], row["buckets"], kind)


_opened: dict[tuple[str, str], Index] = {}


def kept_index(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of a table's files, built in the shared folder on the first call of an application and then kept.

    Tables whose files are rewritten in place during an application need a ``build`` of their own.
    """
    spark = documents.sparkSession
    app, files = spark.sparkContext.applicationId, sorted(documents.inputFiles())
    name = f"{zlib.crc32(chr(10).join(files).encode()):08x}-{len(files)}"
    if (app, name) not in _opened:
        folder = f"{shared_dir(spark)}/index-{app}-{name}"
        build(documents, note_fields(documents, key, text), folder, key, F.col(text))
        _opened[app, name] = open_index(spark, folder, key)
    return _opened[app, name]
