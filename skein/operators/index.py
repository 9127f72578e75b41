"""Inverted index of documents, and lexical, vector and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.guards import once
from skein.functions.text import body, front_matter, tokens
from skein.plans.passes import in_passes

K1, B = 1.5, 0.75


def searchable(documents: DataFrame, text: str = "text") -> Column:
    """Title twice, tags and body of a note with front matter; the text itself else."""
    meta = front_matter(F.col(text))
    title = F.coalesce(F.try_element_at(meta, F.lit("title")), F.lit(""))
    return F.concat_ws(" ", title, title, F.coalesce(F.try_element_at(meta, F.lit("tags")), F.lit("")), body(F.col(text)))


def counted(documents: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(key, term, n, total): how often each term comes, and the number of the document's terms. Null or empty texts have none.

    Terms are counted before they are shuffled; a document's total is summed from its counts.
    """
    split = documents.select(key, tokens(F.col("text") if text is None else text).alias("terms"))
    # the total goes along with each term, so that no second pass or join is needed
    each = split.select(key, F.size("terms").alias("total"), F.explode("terms").alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("n"), F.max("total").alias("total"))


def postings(documents: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(key, term, n, tf): term frequencies, tf the share of the document's terms; see ``counted``."""
    return counted(documents, key, text).select(key, "term", "n", (F.col("n") / F.col("total")).alias("tf"))


def inverse_frequency(posted: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf): ln((1 + N) / (1 + df)) + 1."""
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)


def lengths(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, dl): length as the index keeps it, the inverse of the least term frequency, rounded half to even."""
    return posted.groupBy(key).agg(F.rint(1 / F.min("tf")).cast("bigint").alias("dl"))


def query_terms(query: str) -> list[str]:
    """Terms of a query as the index has them; repeated ones stay."""
    from skein.vocab import STOP_WORDS

    kept = "".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in query.lower())
    return [t for t in kept.split() if len(t) > 1 and t not in STOP_WORDS]


def _weights(terms: list[str]) -> Column:
    """Multiplicity of a term in the query, a literal map."""
    counts = {t: terms.count(t) for t in dict.fromkeys(terms)}
    return F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))


def _equals(term: str):
    return lambda x: x == term


def profile(documents: DataFrame, terms: list[str], key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(key, dl, counts): length as the index keeps it and how often each of ``terms`` comes, row by row, without a shuffle.

    Documents without terms have no row.
    """
    split = documents.select(key, once(F.sort_array(tokens(F.col("text") if text is None else text))).alias("ts")).where(F.size("ts") > 0)
    state = F.struct(F.lit("").alias("at"), F.lit(0).alias("run"), F.lit(2**31 - 1).alias("least"))
    # the sorted terms in runs: the least frequent one tells the length
    close = lambda s: F.when(s["run"] > 0, F.least(s["least"], s["run"])).otherwise(s["least"])
    step = lambda s, t: F.when(s["at"] == t, F.struct(s["at"].alias("at"), (s["run"] + 1).alias("run"), s["least"].alias("least"))).otherwise(F.struct(t.alias("at"), F.lit(1).alias("run"), close(s).alias("least")))
    least = F.aggregate("ts", state, step, close)
    counts = F.array(*(F.size(F.filter("ts", _equals(t))) for t in terms)) if terms else F.array().cast("array<int>")
    return split.select(key, F.rint(F.size("ts") / least).cast("bigint").alias("dl"), counts.alias("counts"), F.size("ts").alias("total"))


def bm25(documents: DataFrame, query: str, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(key, score) of the documents that hold a term of the query; a term that the query repeats counts as often.

    A query without terms gives no rows. Two scans of the documents, the first for the counts of documents, terms and
    lengths; nothing but one row is shuffled.
    """
    asked = query_terms(query)
    terms = list(dict.fromkeys(asked))
    own = profile(documents, terms, key, text)
    held = [F.count_if(F.col("counts")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    whole = own.agg(F.avg("dl").alias("avg_dl"), *held)
    every = documents.agg(F.count("*").alias("n_docs"))
    scored = own.where(F.exists("counts", lambda c: c > 0)).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(every))  # one row each
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        raw = F.col("counts")[i] / F.col("total") * F.col("dl")
        idf = F.log((1 + F.col("n_docs")) / (1 + F.col(f"df{i}"))) + 1
        score = score + asked.count(t) * F.when(raw > 0, idf * raw * (K1 + 1) / (raw + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))).otherwise(0.0)
    return scored.select(key, score.alias("score")).where("score > 0")


def tfidf_cosine(posted: DataFrame, query: str, documents: int, key: str = "doc_id") -> DataFrame:
    """(key, score): cosine of the query's and the documents' tf-idf vectors, over documents that share a term."""
    terms = query_terms(query)
    weighted = posted.join(inverse_frequency(posted, documents).select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    own = F.element_at(_weights(terms or [""]), F.col("term")) / F.lit(float(max(1, len(terms)))) * F.col("idf")
    is_hit = F.col("term").isin(terms or [""])
    per_doc = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.when(is_hit, F.col("w") * own).otherwise(0.0)).alias("dot"))
    norm = weighted.where(is_hit).groupBy("term").agg(F.first(own * own).alias("q")).agg(F.sqrt(F.sum("q")).alias("q_norm"))
    scored = per_doc.where("dot > 0").crossJoin(F.broadcast(norm))  # norm is one row
    return scored.select(key, (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k vectors nearest to the one of ``query`` (one row, column q), exactly.

    Similarities are compared by nine digits, ties by key.
    """
    scored = vectors.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(query)).select(key, cosine(F.col(vector), F.col("q")).alias("similarity"))
    return scored.where("similarity is not null").orderBy(F.desc(F.round("similarity", 9)), key).limit(k)


#: Query vectors sent to the tasks at once, and vectors compared with them at once.
QUERY_BLOCK, VECTOR_BLOCK = 512, 2048


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, rank, similarity): for each row of ``queries`` the k vectors nearest to it, exactly; key is a BIGINT.

    Similarities are compared by nine digits, ties by key. The queries are taken in blocks of bounded size with one pass
    over the vectors a block; a task keeps the k best of each query. Vectors and queries that are null, hold a null or have
    no finite length above 0 have no rows; vectors of another dimension than the query's aren't compared with it.
    """
    asked = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(key).agg(F.min(vector).alias("q"))

    def blocks() -> Iterator[list[tuple]]:
        block, any_ = [], False
        for row in asked.toLocalIterator():
            block.append((row[key], row.q))
            if len(block) == QUERY_BLOCK:
                yield block
                block, any_ = [], True
        if block or not any_:
            yield block

    def search(shared) -> DataFrame:
        own = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>"))
        return own.mapInArrow(_nearest(shared, k, key), f"query BIGINT, {key} BIGINT, similarity DOUBLE")

    found = in_passes(vectors.sparkSession, blocks(), search)
    own = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), key)
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query", key, "rank", "similarity")


def _nearest(shared, k: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def unit(m):
            """Rows of length 1 and which rows have one."""
            length = np.sqrt((m * m).sum(axis=1))
            sound = np.isfinite(length) & (length > 0)
            return m[sound] / length[sound, None], sound

        sides: dict[int, list] = {}
        for i, v in shared.value:
            if v and None not in v:
                sides.setdefault(len(v), []).append((i, v))
        best = {}
        for size, own in sides.items():
            m, sound = unit(np.array([v for _, v in own], dtype="float64"))
            ids = np.array([i for i, _ in own], dtype="int64")[sound]
            best[size] = [ids, m, np.zeros((len(ids), 0), "int64"), np.zeros((len(ids), 0))]
        for batch in batches:
            for start in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(start, VECTOR_BLOCK)
                lengths = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                for size, state in best.items():
                    held = part.filter(pa.array(lengths == size))
                    if not held.num_rows:
                        continue
                    flat = held.column(1).flatten()
                    m, sound = unit(flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size))  # null is NaN here
                    ids, q, keys, near = state
                    keys = np.hstack([keys, np.broadcast_to(held.column(0).to_numpy()[sound], (len(ids), len(m)))])
                    near = np.hstack([near, q @ m.T])
                    order = np.lexsort((keys, -np.round(near, 9)), axis=-1)[:, :k]
                    state[2], state[3] = np.take_along_axis(keys, order, 1), np.take_along_axis(near, order, 1)
        for ids, _, keys, near in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keys.shape[1])), pa.array(keys.ravel()), pa.array(near.ravel())], names=["query", key, "similarity"])

    return run


def fuse(lexical: DataFrame, near: DataFrame, k: int, weight: float = 0.3, key: str = "doc_id") -> DataFrame:
    """(key, score): lexical and vector scores, each divided by its greatest, weighted and added; the k best by eight digits, ties by key.

    near has (key, similarity); a similarity s counts as 1 / (2 - s). Without vectors the greatest score is 1 - weight.
    """
    close = near.select(key, (1 / (2 - F.col("similarity"))).alias("close"))
    top_score, top_close = lexical.agg(F.max("score").alias("ms")), close.agg(F.max("close").alias("mc"))
    both = lexical.join(close, key, "full").crossJoin(F.broadcast(top_score)).crossJoin(F.broadcast(top_close))  # one row each
    part = lambda x, m: F.coalesce(F.try_divide(F.col(x), F.col(m)), F.lit(0.0))
    return both.select(key, (part("score", "ms") * (1 - weight) + part("close", "mc") * weight).alias("score")).orderBy(F.desc(F.round("score", 8)), key).limit(k)


def to_index(notes: DataFrame, indexed: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Notes whose (path, content hash) the index table doesn't hold yet: new and edited ones."""
    hashed = notes.withColumn("content_hash", F.sha2(text, 256))
    return hashed.join(indexed.select(path, "content_hash"), [path, "content_hash"], "left_anti")


def section(rank: int, r: dict, chars: int) -> str:
    """One result: rank, title and score, a block of what is known of it, and its snippet cut at a space to so many characters."""
    known = [f"{k}: {r[k]}" for k in ("type", "domain", "tags") if r.get(k)] + [f"source: {(r.get('path') or '').rsplit('/', 1)[-1]}"]
    text = r.get("snippet") or ""
    if len(text) > chars:
        text = text[:chars].rsplit(" ", 1)[0] + "…"
    return "\n".join([f"## [{rank}] {r.get('title') or ''}  (score: {r.get('score') or 0:.3f})", "```yaml", *known, "```", *([text] if text else []), ""])


def context(results: list[dict], query: str | None = None, budget: int = 4000, per_result: int = 300) -> str:
    """Sections of at most fifty ranked results below a header, as many as fit the token budget (four characters a token).

    A section that doesn't fit is tried once more with a shorter snippet; if that doesn't fit either, it ends there.
    """
    if not results:
        return ""
    header = f"# Vault context for: {query}\n\n" if query else ""
    left, out = budget * 4 - len(header), []
    for rank, r in enumerate(results[:50], 1):
        own = section(rank, r, per_result * 4)
        if len(own) > left:
            own = section(rank, r, max(200, left - 300))
        if len(own) > left:
            break
        out.append(own)
        left -= len(own)
    return (header + "\n".join(out)).strip()
