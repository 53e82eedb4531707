from civiltext.operators import matching as mt


def test_phrases_of_any_length_are_found(spark):
    df = spark.createDataFrame([(1, "you go now to bed".split()), (2, ["bed"]), (3, [])], "msg_id long, w array<string>")
    table = spark.createDataFrame([(t, "x") for t in ("bed", "now go", "to go you now", "bed to now go you")], "term string, lang string")
    got = {(r.msg_id, r.term): r.n for r in mt.match_phrase_keys(df, table).collect()}
    assert got == {(1, "bed"): 1, (2, "bed"): 1, (1, "now go"): 1, (1, "to go you now"): 1, (1, "bed to now go you"): 1}
