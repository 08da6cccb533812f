from tests.llm import brute

from strandlake.llm import licenses

TEXTS = {
    1: None, 2: "", 3: "Released under the MIT License.", 4: "mit  LICENSE mit\nlicense, apache-license", 5: "mitlicense mit licenses",
    6: "x " * 500 + "GNU General Public License, version 3.", 7: "MIT Li\u212aense mit l\u0130cense", 8: "émit license, mit license é",
    9: "This work is licensed under the GNU General (really) Public License, version 3.", 10: "Licensed under CC BY-NC 4.0.", 11: "license",
}


def test_phrases_match_words_one_by_one(spark, docs_of):
    got = {r.doc_id: r for r in licenses.scan(docs_of(TEXTS)).collect()}
    for i, text in TEXTS.items():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(text), i
        assert 0 <= r.score <= 1


def test_templates_add_labels_over_gaps(spark, docs_of):
    got = {r.doc_id: r for r in licenses.scan(docs_of(TEXTS)).collect()}
    assert got[10].labels == "cc-by-nc" and got[10].base_labels == "" and got[10].score == 1.0
    assert got[9].labels == "gpl" and got[9].base_labels == "" and 0.6 <= got[9].score <= 1
    assert got[11].labels == "" and got[11].score == 0


def test_spans_are_where_the_template_stands(spark, docs_of):
    rows = licenses.template_spans(docs_of({1: "a b c licensed under the apache license version 2.0 d"})).collect()
    assert {(r.label, r.first_word, r.last_word) for r in rows} == {("apache", 3, 10)}


def test_repeats_and_no_rows(spark, docs_of):
    rows = licenses.scan(docs_of([(1, "mit license"), (1, "mit license"), (None, "mit license")])).collect()
    assert [(r.doc_id, r.n_base, r.labels) for r in rows] == [(r.doc_id, 1, "mit") for r in rows] and len(rows) == 3
    assert licenses.scan(docs_of({}).limit(0)).count() == 0
