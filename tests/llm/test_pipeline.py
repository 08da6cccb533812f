"""The stages on a small collection, held against plain versions of what each promises."""

import random
import zlib

import numpy as np
from tests.llm import brute
from tests.llm.test_packing import ids_of
from tests.llm.test_quality import words

import corpus_pipeline
from strandlake.llm import near_dedup
from strandlake.llm.common import keep


def test_stages_do_what_they_promise(spark, docs_of, tmp_path):
    r = random.Random(11)
    texts = {i: words(r, r.randrange(40, 90)) for i in range(300)}
    texts |= {400 + i: texts[i] for i in range(5)}  # exact copies
    texts |= {500 + i: texts[10 + i] + " the" for i in range(5)}  # near copies
    texts |= {600 + i: " ".join(w.upper() + "!!" for w in words(r, 60).split()) for i in range(5)}  # junk
    texts[700] = words(r, 150) + " password=the1ing2on3er4 " + words(r, 150)
    docs = docs_of([(i, t, "abc"[i % 3]) for i, t in texts.items()]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    state, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = state.columns
    for name, stage in corpus_pipeline.STAGES:
        state = keep(stage(spark, state, str(tmp_path)))
        kept.append(state)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == columns
    rows = [[(x.doc_id, x.text) for x in df.collect()] if "text" in df.columns else None for df in kept]
    clean = {i for i in texts if not 600 <= i < 605}
    assert not {i for i, _ in rows[0]} & set(range(600, 605)) and len(clean - {i for i, _ in rows[0]}) <= 3
    first = dict(rows[0])
    assert {i for i, _ in rows[1]} == {i for i, (_, c) in brute.near_duplicates(first).items() if i == c}
    assert all(not brute.base_spans(t) for _, t in rows[2]) and {i for i, _ in rows[2]} == {i for i, _ in rows[1]}
    assert dict(rows[2])[700].count("[SECRET]") == 1 and dict(rows[2])[700].startswith(texts[700][:80])
    total = sum(brute.size(t) for _, t in rows[2])
    assert abs(sum(brute.size(t) for _, t in rows[3]) - 1.5 * total) <= 3 * 100
    packed = kept[4].collect()
    assert sum(p.length for p in packed) == sum(len(ids_of(t)) for _, t in rows[3])
    some = next(p for p in packed if p.start == 0)
    ids = ids_of(dict(rows[3])[some.doc_id])
    assert some.ids_crc32 == zlib.crc32(ids[: some.length].tobytes()) and isinstance(ids, np.ndarray)


def test_run_of_no_documents(spark, docs_of, tmp_path):
    docs_of({}).limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_between_0_80_and_0_85_go(spark, docs_of):
    base = [f"w{i}" for i in range(54)]
    other = [*base[:25], "changed", *base[26:]]
    assert 0.80 <= len(brute.shingles(" ".join(base)) & brute.shingles(" ".join(other))) / len(brute.shingles(" ".join(base)) | brute.shingles(" ".join(other))) < 0.85
    docs = docs_of({1: " ".join(base), 2: " ".join(other), 3: "something else altogether"})
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
    assert near_dedup.least_agreeing(80) == 34 and near_dedup.least_agreeing(85) == 39
