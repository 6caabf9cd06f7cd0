"""The search index against a scan, learnt sentence boundaries against planted ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphmill.operators import search, sentences
from graphmill.plans import composition as comp
from graphmill.sources import versions


def entities(spark, n=700):
    rng = random.Random(5)
    words = ["apple", "juice", "green tea", "red", "100%", "a_b", "tocopherol", "alpha", "β-carotene", "x"]
    rows = []
    for k in range(n):
        name = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        tokens = list(dict.fromkeys(["food" if k % 3 else "chemical", name, rng.choice(words), f"id{k}"]))
        rows.append((f"e{k}", name, "    ".join(tokens), tokens, rng.choice([None, 0, 1, 2, 3, 14, 15, 200, 5000, rng.randint(0, 90)])))
    return spark.createDataFrame(rows, "entity_id string, name string, token_text string, tokens array<string>, associations long")


def test_search_index_equals_scan(spark, tmp_path):
    root, e = str(tmp_path), entities(spark)
    scan = e.withColumn("associations", F.coalesce("associations", F.lit(0)))
    seen = search.build_index(e, root)
    rng = random.Random(8)
    texts = [r.token_text for r in e.limit(200).collect()]
    terms = {"food", "APPLE", "pp", "e", "100%", "%", "_b", "a_b", "zzzz", "id7", "juice apple", "    ", "β-c", "red    "}
    for t in texts[:25]:
        at, size = rng.randrange(len(t)), rng.randint(3, 12)
        terms.add(t[at : at + size])
    asked = spark.createDataFrame([(t,) for t in sorted(terms)] + [(None,), ("",), ("food",)], "term string")
    for number in (1, 3):
        got = search.search_index(spark, root, asked, 4, number, seen).collect()
        mine = {}
        for r in got:
            mine.setdefault(r.term, []).append((r.rank, r.entity_id, r.exact, r.associations, round(r.similarity, 6)))
        for t in {t.lower() for t in terms if t}:
            want = [(r.rank, r.entity_id, r.exact, r.associations, round(r.similarity, 6)) for r in comp.search(scan, t, 4, number).collect()]
            assert sorted(mine.get(t, [])) == sorted(want), t


def test_search_index_reads_few_parts(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    seen = search.build_index(entities(spark), root)
    read, whole = [], versions.read
    monkeypatch.setattr(versions, "read", lambda s, r, table, schema, at=None, parts=None: read.append((table, len(parts))) or whole(s, r, table, schema, at, parts))
    top = search.search_index(spark, root, spark.createDataFrame([("food",)], "term string"), 3, 1, seen)
    assert top.count() == 3 and {r.exact for r in top.collect()} == {True}
    # whole tokens of the highest band complete the page: no posting is read, one part of the tokens, few of the entities
    assert sum(n for t, n in read if t == "postings") == 0 and sum(n for t, n in read if t == "tokens") == 1
    assert sum(n for t, n in read if t == "entities") < len(seen.tables["entities"]) / 2
    read.clear()
    assert search.search_index(spark, root, spark.createDataFrame([("copher",)], "term string"), 2, 1, seen).count() == 2
    assert 0 < sum(n for t, n in read if t == "postings") <= 3 * len(search.bands(seen)) < len(seen.tables["postings"]) / 4
    empty = search.build_index(entities(spark).limit(0), f"{root}/empty")
    assert search.search_index(spark, f"{root}/empty", spark.createDataFrame([("food",)], "term string"), 3, 1, empty).count() == 0


def test_planted_sentence_boundaries(spark):
    """Abbreviations, initials, numbers and collocations that no list names; precision and recall of the cuts."""
    rng = random.Random(11)
    plain = "the leaf holds some acid and sugar that was found in green tea after two days of storage near water".split()
    openers = ["We", "This", "It", "Results"]
    names = ["Kaskow", "Brenda", "Tollan"]

    def sentence():
        words = [rng.choice(plain) for _ in range(rng.randint(4, 12))]
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(1, len(words))
            words[k:k] = rng.choice([["fg.", str(rng.randint(1, 9))], ["cf.", rng.choice(plain)], ["e.g.", rng.choice(plain)], ["Dr.", rng.choice(names)], [rng.choice("ABCD") + ".", rng.choice(names)], ["no.", "5", "of"], ["pH", "5.3"]])
        return " ".join([rng.choice(openers), *words]) + rng.choice([".", ".", ".", "!", "?", ".)", '."'])

    docs, cuts = [], []
    for k in range(300):
        made = [sentence() for _ in range(rng.randint(1, 20))]
        docs.append((k, "  ".join(made) if k % 2 else "\n".join(made)))
        cuts.append(made)
    odd = [(900, None), (901, ""), (902, " \n "), (903, "no end mark"), (904, "..."), (905, "a. b"), (906, "One.Two three.")]
    frame = spark.createDataFrame(docs + odd + [docs[0]], "id int, text string")
    learnt = sentences.learn(frame)
    found = {r.base for r in learnt.abbreviations.collect()}
    assert {"fg", "cf", "e.g", "dr"} <= found and not found & set(plain)
    out = {}
    for r in sentences.split_sentences(frame, "text", ["id"], learnt).collect():
        out.setdefault(r.id, {})[r.sentence_no] = r.sentence
    hit = said = true = 0
    for k, made in enumerate(cuts):
        got = [out[k][i] for i in sorted(out[k])]
        assert sorted(out[k]) == list(range(len(got))) and " ".join(" ".join(got).split()) == " ".join(" ".join(made).split())
        ends = lambda xs: {sum(map(lambda x: len(x.split()), xs[: i + 1])) for i in range(len(xs) - 1)}
        a, b = ends(got), ends(made)
        hit, said, true = hit + len(a & b), said + len(a), true + len(b)
    assert hit / said > 0.99 and hit / true > 0.97, (hit, said, true)
    assert 900 not in out and 901 not in out and 902 not in out and out[903] == {0: "no end mark"} and out[906] == {0: "One.Two three."}
    nothing = sentences.learn(frame.limit(0))
    assert nothing.abbreviations.count() == 0 and sentences.split_sentences(frame.filter("id = 903"), "text", ["id"], nothing).count() == 1


def test_learning_reads_texts_twice(spark):
    """Words and the words that may end a sentence are counted in one pass each, whatever is learnt from them."""
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(f"Text {k} has fg. {k} and fg. {k} of a leaf. It is done! Is it? Yes.",) for k in range(40)]
    learnt = sentences.learn(spark.createDataFrame(rows, "text string").select(seen.asNondeterministic()("text").alias("text")))
    assert learnt.words.count() > 0 and read.value <= 2 * len(rows)


def test_odd_ends_and_marks(spark):
    """Words of nothing but marks, a text's own control characters, and white space of all kinds; nothing is lost but that."""
    nothing = sentences.learn(spark.createDataFrame([], "text string"))
    texts = {". . a": [".", ".", "a"], " \t\"A bee.\"\x0bC!)\nD": ['"A bee."', "C!)", "D"], f"a {sentences.CUT}b. c": [f"a {sentences.CUT}b.", "c"], "a.'b\" c?": ["a.'b\" c?"], "x!! y\u00a0z. ": ["x!!", "y\u00a0z."], ")": [")"]}
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {}
    for r in sentences.split_sentences(frame, "text", ["id"], nothing).collect():
        out.setdefault(r.id, {})[r.sentence_no] = r.sentence
    assert [[out[k][i] for i in sorted(out[k])] for k in range(len(texts))] == list(texts.values())
