"""License scans against a plain search, word by word."""

import random
import re

from tidewatch.llm.licenses import PHRASES, SENTENCES, common_words, license_scan, op12_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    words, places = words_of(text), []
    for label, phrase in PHRASES:
        wanted = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    return len(words), sorted(places)


def check(rows, texts):
    for r in rows:
        n_words, places = base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n_words, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert any("gpl" in r["labels"] for r in rows)


def test_odd_texts(spark, tmp_path):
    rng = random.Random(5)
    said = ["under", "the", "MIT", "license", "cc", "by", "nc", "Apache", "version", "2", "é"]
    texts = {i: rng.choice(["", " ", "x "]) + "".join(rng.choice(said) + rng.choice([" ", "-", ".\n", ", "]) for _ in range(rng.randrange(0, 60))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "cc by nc " * 30_000, 303: "x" * 3_000_000 + " under the mit license", 304: "CC BY-NC", 305: "cc by", 306: "under the mit licenseé", 307: texts[3], 308: "\0cc\0by\0nc"}
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in texts.items()], "doc_id long, text string, n_words int, found string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(op12_licenses(spark, str(tmp_path)).collect(), texts)
    twice = spark.createDataFrame([(None, "cc by nc"), (None, "cc by nc"), (1, "cc by nc"), (1, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, len(r["spans"])) for r in license_scan(twice).collect()) == [(False, 0), (False, 1), (True, 1), (True, 1)]
    assert license_scan(twice.limit(0)).collect() == []


def test_sentences_with_changes(spark):
    rng = random.Random(2)
    rows, wanted = [], {}
    for i, (label, sentence) in enumerate(SENTENCES * 4):
        words = sentence.split()
        if len(words) >= 15:
            place = rng.randrange(3, len(words) - 3)
            words[place : place + 1] = rng.choice([[], ["other"], [words[place], "more"]])
        rows.append((i, " ".join(["before"] * rng.randrange(9) + words + ["after"] * rng.randrange(9)).title()))
        wanted[i] = label
    rows.append((1000, "permission is not granted to anybody and the software of this file is what it is"))
    for bound in (500_000, 0):
        got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), bound=bound).collect()}
        assert all(wanted[i] in got[i] for i in wanted) and got[1000] == set()


def test_common_words():
    assert common_words("a b c d".split(), "x a c b d d".split()) == 3
    assert common_words(["a"], []) == 0
