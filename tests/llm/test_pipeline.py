"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import hashlib
import re
import zlib

import corpus_pipeline
from perigee.llm import decontaminate, language, simhash
from perigee.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    seen = {}
    for n, f in corpus_pipeline.STAGES:
        before = rows(kept)
        kept = f(spark, kept, SF)
        kept.write.parquet(str(tmp_path / n))
        kept = spark.read.parquet(str(tmp_path / n))
        if n != "best_fit_packing":
            assert kept.columns == docs.columns
            seen[n] = before, sorted(rows(kept))
    model = language.fit(docs.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    before, after = seen["language_id"]
    lang, score, _ = language.predict([(t or "").encode() for _, t in before], model)
    assert after == sorted(r for r, x, s in zip(before, lang, score, strict=True) if x != "und" and s >= 0.5)

    before, after = seen["exact_dedup"]
    first = {}
    for d, t in sorted(before):
        first.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).digest(), (d, t))
    assert after == sorted(first.values())

    before, after = seen["simhash_near_dedup"]
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in before}
    fps = {d: simhash.fingerprints(simhash.shingle_hashes(t.encode(), 5), 5) for d, t in before}
    stay = {d for d, _ in after}
    most = simhash.flips_at(0.8) * 320
    off = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(fps[a], fps[b], strict=True))
    for d, _ in before:
        if d not in stay:  # some document like it, by the whole sketch, is there
            assert any(off(d, e) <= most for e in fps if e != d)
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) and len(sets[a]) > 20]
    assert all(not (a in stay and b in stay) for a, b in near)

    before, after = seen["benchmark_decontamination"]
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decontaminate.windows(r["text"].encode(), 10)]
    flat = lambda t: b" " + b" ".join(decontaminate.words(t.encode())) + b" "
    assert after == sorted((d, t) for d, t in before if not any(w in flat(t) for w in items))

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in after}
    pieces = kept.collect()
    assert sum(r["length"] for r in pieces) == sum(map(len, want.values()))
    for r in pieces:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) == r["ids_crc32"]


def test_nothing_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "the of and", None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, key_id string")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            kept = f(spark, kept, SF)
            if k < 4:
                assert kept.columns == docs.columns
        kept.collect()


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
