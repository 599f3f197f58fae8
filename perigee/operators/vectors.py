"""TF-IDF vectors: as long relations (id, term, weight), and row by row with a lexicon that the workers hold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions.text import tokenize

#: Terms of two works or more that a lexicon holds at most, tokens of a work that count for its distinctiveness, and
#: works that a worker looks up at once.
MOST_TERMS, HEAD, ROWS = 6_000_000, 400, 1024


def tokens(works: DataFrame, most: int = 700) -> DataFrame:
    """(id, tokens) of title and abstract."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return works.select("id", tokenize(text, most).alias("tokens"))


def term_frequencies(toks: DataFrame) -> DataFrame:
    """(id, term, tf). Terms of one row meet in its own task after the explode, so the aggregation combines
    before its shuffle."""
    return toks.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(works: DataFrame) -> DataFrame:
    """One row: the number of works with a title or an abstract."""
    has = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("abstract", F.lit("")) != "")
    return works.where(has).agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n_docs"))


def idf(tf: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf): ln((N + 1) / (df + 1)) + 1. The size is a single row, so its broadcast is bounded."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(size)).select("term", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + F.lit(1.0)).alias("idf"))


def weights(tf: DataFrame, idfs: DataFrame) -> DataFrame:
    """(id, term, w): (1 + ln tf) * idf; a term without idf counts as one."""
    return tf.join(idfs.select("term", "idf"), "term", "left").select("id", "term", ((F.lit(1.0) + F.log("tf")) * F.coalesce("idf", F.lit(1.0))).alias("w"))


def norms(vec: DataFrame) -> DataFrame:
    return vec.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def distinctiveness(works: DataFrame, idfs: DataFrame) -> DataFrame:
    """(id, distinctiveness): the mean idf of the distinct terms among the first 400 tokens; 0 without any."""
    terms = tokens(works, 400).select("id", F.explode(F.array_distinct("tokens")).alias("term"))
    mean = terms.join(idfs.select("term", "idf"), "term", "left").groupBy("id").agg(F.avg(F.coalesce("idf", F.lit(0.0))).alias("d"))
    return works.select("id").join(mean, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("distinctiveness"))


@dataclass
class Lexicon:
    """How many works have a term: sorted 64-bit hashes of the terms of two works or more, their numbers, and the
    number of works. Any other term of the works is in one of them only, so none is lost."""

    table: Broadcast
    n_docs: int


def hashed(works: DataFrame, most: int = 700) -> DataFrame:
    """(id, tokens) with 64-bit hashes of the tokens."""
    return tokens(works, most).select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))


def lexicon(works: DataFrame, most: int | None = None) -> Lexicon | None:
    """The lexicon of the works; none where it would hold more than `most` terms or an id is repeated, whose rows would
    have to be joined first. Then the long relations give the same by joins."""
    most = MOST_TERMS if most is None else most
    has = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("abstract", F.lit("")) != "")
    per_id = works.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("has"))
    size = per_id.agg(F.max("rows").alias("rows"), F.sum("has").alias("n_docs")).first()
    if size["rows"] is None or size["rows"] > 1:
        return None
    terms = hashed(works).select(F.explode(F.array_distinct("tokens")).alias("term"))
    found = terms.groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1").limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    term, df = (found[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("term", "df"))
    order = np.argsort(term)
    return Lexicon(works.sparkSession.sparkContext.broadcast((term[order], df[order])), max(1, size["n_docs"]))


def _profile(flat: np.ndarray, size: np.ndarray, table: tuple[np.ndarray, np.ndarray], n_docs: int) -> tuple[np.ndarray, ...]:
    """(row, term, weight) of the distinct terms of rows with `size` tokens each, and each row's norm, distinctiveness
    and number of terms."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    terms, code = np.unique(flat, return_inverse=True)
    at = np.minimum(np.searchsorted(table[0], terms), max(0, len(table[0]) - 1))
    df = np.where(table[0][at] == terms, table[1][at], 1) if len(table[0]) else np.ones(len(terms), np.int32)
    idf = np.log((n_docs + 1) / (df + 1.0)) + 1.0
    key, first, tf = np.unique(row * max(1, len(terms)) + code, return_index=True, return_counts=True)
    row, code = key // max(1, len(terms)), key % max(1, len(terms))
    w = (1.0 + np.log(tf)) * idf[code]
    early = first - (np.cumsum(size) - size)[row] < HEAD
    total, many = (np.bincount(row[early], x, n) for x in (idf[code[early]], None))
    distinct = np.divide(total, many, out=np.zeros(n), where=many > 0)
    return row, terms[code], w, np.sqrt(np.bincount(row, w * w, n)), distinct, np.bincount(row, minlength=n)


def profiles(works: DataFrame, lex: Lexicon, packed: bool = True) -> DataFrame:
    """(id, terms, weights, norm, distinctiveness) of each work, terms as sorted hashes; no terms and weights unless
    `packed`. The norm of a work without tokens is null. Nothing is shuffled."""
    table, n_docs = lex.table, lex.n_docs
    toks = hashed(works)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                size = b["tokens"].value_lengths().to_numpy(zero_copy_only=False)
                _, term, w, norm, distinct, own = _profile(b["tokens"].flatten().to_numpy(zero_copy_only=False), size, table.value, n_docs)
                ends = pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term, w)] if packed else []
                yield pa.RecordBatch.from_arrays([b["id"], *lists, pa.array(norm, mask=own == 0), pa.array(distinct)], names)

    names = ["id", *(["terms", "weights"] if packed else []), "norm", "distinctiveness"]
    lists = "terms array<long>, weights array<double>, " if packed else ""
    return toks.mapInArrow(run, f"id {dict(toks.dtypes)['id']}, {lists}norm double, distinctiveness double")


def joined_profiles(works: DataFrame, idfs: DataFrame) -> DataFrame:
    """profiles() by joins with the idf of all terms, for any number of terms."""
    vec = weights(term_frequencies(tokens(works)), idfs)
    own = vec.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w"))).alias("v"))
    all_of = distinctiveness(works, idfs).join(own, "id", "left").join(norms(vec), "id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return all_of.select("id", none("v.t", "long").alias("terms"), none("v.w", "double").alias("weights"), "norm", "distinctiveness")


def lengths(works: DataFrame) -> DataFrame:
    """(id, norm) of the works with a token, idf taken over them all."""
    lex = lexicon(works)
    if lex is not None:
        return profiles(works, lex, packed=False).where("norm IS NOT NULL").select("id", "norm")
    tf = term_frequencies(tokens(works))
    return norms(weights(tf, idf(tf, corpus_size(works))))


def own_distinctiveness(works: DataFrame) -> DataFrame:
    """(id, distinctiveness) of all works, idf taken over them all."""
    lex = lexicon(works)
    if lex is not None:
        return profiles(works, lex, packed=False).select("id", "distinctiveness")
    return distinctiveness(works, idf(term_frequencies(tokens(works)), corpus_size(works)))
