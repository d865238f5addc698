"""The binary test on whole texts."""

from thicket.plans import catalog


def test_whole_texts_are_sniffed(spark, tmp_path):
    texts = {1: "a" * 8191 + "ä", 2: "a" * 8190 + "ä", 3: "ä" * 4096, 4: "a" + "ä" * 9000, 5: "plain", 6: "", 10: "plain", 11: "a" * 3000 + "\0", 12: "a" * 8192 + "\0"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def binary(doc_id, text):
        head = (b"\0" if doc_id % 10 == 0 else b"\xff" if doc_id % 5 == 0 else b"") + text.encode()
        try:
            return "\0" in head[:8192].decode()
        except UnicodeDecodeError:
            return True

    got = {r["doc_id"]: r["is_binary"] for r in catalog.binary_sniff(spark, str(tmp_path)).collect()}
    assert got == {i: binary(i, t) for i, t in texts.items()}
    assert {i for i, x in got.items() if x} == {1, 4, 5, 10, 11}
