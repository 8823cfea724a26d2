from corvane.llm.fingerprints import fingerprints


def test_sentences_of_other_scripts_are_paragraphs(spark):
    rows = [(k, mark.join(chr(start + 7 * k + i) * 9 + chr(start + i) for i in range(60)) + mark) for k, (start, mark) in enumerate([(0x4E00, "\u3002"), (0x905, "\u0964 "), (0x5500, "\uff01")])]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_chars >= 400 and r.near_edited > 0.5 for r in got)


def test_texts_without_marks_have_paragraphs_too(spark):
    rows = [(1, " ".join(f"word{k}" for k in range(300))), (2, "".join(chr(0x4E00 + (k * k) % 4001) for k in range(900))), (3, "a" * 3000 + ". b. c. d. e")]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_edited > 0.5 and got[2].near_edited > 0.5 and [got[k].fingerprint[0] for k in (1, 2, 3)] == ["1", "0", "0"]
    assert all(r.near_next < 0.2 for r in got.values())
