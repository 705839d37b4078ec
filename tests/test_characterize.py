from tidewatch.cli import main
from tidewatch.operators import characterize as C


def test_tiers_and_places(spark, capsys):
    rows = [("Toxin A, effector", 90.0), ("pilus", 10.0), ("kinase", 80.0), ("kinase", None)]
    got = [(r["tier"], r["flags"]) for r in C.risk_tiers(spark.createDataFrame(rows, "title string, confidence double")).collect()]
    assert got == [("HIGH", ["toxin", "effector"]), ("MODERATE", ["pilus"]), ("MONITOR", []), ("LOW", [])]
    atoms = spark.createDataFrame([("p", f"ATOM  {'':54}{b:6.2f}") for b in (0.5, 0.7)] + [("p", "TER")], "name string, line string")
    assert abs(C.structure_confidence(atoms).first()["confidence"] - 60) < 1e-9
    places = spark.createDataFrame([("york", 1.0, 2.0), ("new york", 42.165, -74.948)], "name string, lat double, lon double")
    samples = spark.createDataFrame([("a", "43.07 N 89.40 W", "x"), ("b", None, "USA: New York"), ("c", None, "nowhere")], "sample string, lat_lon string, place string")
    got = {r["sample"]: (r["lat"], r["lon"]) for r in C.located(samples, places).collect()}
    assert got == {"a": (43.07, -89.4), "b": (42.165, -74.948), "c": (None, None)}
    assert main(["plan", "0.001"]) == 0 and '"confidence": 0.95' in capsys.readouterr().out


def test_words_in_one_pass(spark):
    import random

    from tidewatch.operators.words import longest_word, words_in

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["", None, "É"]
    texts = ["".join(rng.choice("abcABC ") for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, "éa", "x"]
    known = sorted({w.lower() for w in words if w})
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    for shard in (1000, 7):
        got = {r["text"]: r["words"] for r in words_in(rows, listed, shard).collect()}
        assert got == {t: h for t in texts if t for h in [[w for w in known if w in t.lower()]] if h}
    best = {r["text"]: r["word"] for r in longest_word(rows, listed).collect()}
    assert best == {t: max(h, key=lambda w: (len(w), w)) for t, h in got.items()}
    assert words_in(rows, []).collect() == []
