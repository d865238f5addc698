"""The pipeline's line stage on lines of few words."""

import corpus_pipeline


def test_short_repeated_lines_go(spark):
    rows = [(1, "first text\nAll rights reserved.\n\nlast one"), (2, "second\n\nAll rights reserved.\n\nother end"), (3, "All rights reserved."), (4, "\n\nfourth\nfourth")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got[1]["text"] == rows[0][1]
    # a blank line goes only with the repeated words that it adjoins
    assert "All rights" not in got[2]["text"] and got[2]["text"].split() == ["second", "other", "end"]
    assert got[3]["text"] == "" and got[3]["n_chars"] == 0
    assert got[4]["text"] == "\n\nfourth"
