import random

import numpy as np

from octaray.llm import pii, toxicity
from octaray.llm.common import crc_mod

INSULTS = "idiot moron worthless pathetic".split()


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    parts = "ka lo mi ter on sa ve du pri na".split()
    words = lambda k: ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(k)]
    rows, marks = [], []
    for i in range(n):
        text, bad = words(rng.randint(5, 60)), i % 6 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text), "x"))
        marks.append((i, 0, int(bad)))
    return rows, marks


DISGUISED = ["you 1d10t", "such a M0R0N!", "i d i o t", "p.a.t.h.e.t.i.c", "woooorthlesss", "an idi0000t here", "id*ot", "WORTHLESS."]


def test_disguised_words_are_restored(spark):
    rows, marks = labelled()
    rows += [(5000 + k, t, "x") for k, t in enumerate(DISGUISED)] + [(6000, None, "x"), (6001, "", "x"), (6002, "kalo 1993 mi-ter 10.0.0.1 b2b aaa", "x"), (6003, "kalo " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (0, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, fold=lambda i: crc_mod(i, 3) != 1)
    got = {r["doc_id"]: r["p"] for r in toxicity.score_texts(docs, model, out="p").collect()}
    assert all(got[5000 + k] >= 0.7 for k in range(len(DISGUISED))), [t for k, t in enumerate(DISGUISED) if got[5000 + k] < 0.7]
    assert all(0 <= got[i] < 0.5 for i in range(6000, 6004))
    wrong = [i for i, _, bad in marks if (got[i] >= 0.7) != bool(bad)]
    assert len(wrong) <= 0.02 * len(marks)


def test_decoding_keeps_plain_words():
    counts = np.ones(toxicity.CLASSES**4, dtype=np.int64)
    model, classes = toxicity.character_model(counts), {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}
    assert np.allclose(np.exp(model).sum(axis=1), 1, atol=1e-4)
    for word in ("plain", "bookkeeper", "été"):
        assert toxicity.decode(word, model, classes) == word


def test_decoding_is_the_best_of_all_readings():
    """Viterbi against every path of the lattice, under a character model counted from words."""
    rng = np.random.default_rng(3)
    counts = np.zeros(toxicity.CLASSES**4, dtype=np.int64)
    table = toxicity.class_table()
    for word in "idiot moron pathetic worthless late tale ill toil goat boat allot tattoo".split() * 20:
        code = table[np.frombuffer(f"\n\n\n{word}\n".encode(), dtype=np.uint8)]
        np.add.at(counts, ((code[:-3] * 28 + code[1:-2]) * 28 + code[2:-1]) * 28 + code[3:], 1)
    model, classes = toxicity.character_model(counts), {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}

    def worth(text, cost):
        code = [0, 0, 0, *(classes.get(c, 27 if c.isalpha() else 0) for c in text), 0]
        return cost + sum(float(model[(code[i] * 28 + code[i + 1]) * 28 + code[i + 2], code[i + 3]]) for i in range(len(code) - 3))

    tokens = ["1d10t", "m0r*n", "p.a-t", "ttta1!", "g0|at", "b00at", "é1l", "*#o"]
    tokens += ["".join(rng.choice(list("aotil013|.*"), rng.integers(1, 5))) for _ in range(60)]
    for token in tokens:
        paths = [("", 0.0)]
        for options in toxicity.lattice(token):
            paths = [(said + text, cost + more) for said, cost in paths for text, more in options]
        best = max(worth(*p) for p in paths)
        said = toxicity.decode(token, model, classes)
        assert abs(max(worth(t, c) for t, c in paths if t == said) - best) < 1e-4, (token, said)


def test_a_score_at_the_threshold_is_toxic(spark):
    """One word with a precision of 0.7, alone and with others; a score is the noisy-or of what a text shows."""
    chars = spark.sparkContext.broadcast(toxicity.character_model(np.ones(toxicity.CLASSES**4, dtype=np.int64)))
    model = {"chars": chars, "features": {"=kalomi": 0, "=terona": 1}, "precision": [toxicity.THRESHOLD, 0.5], "base": 0.0}
    rows = [(1, "a kalomi b"), (2, "terona"), (3, "Kalomi terona kalomi"), (4, "x" * 50_000), (5, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert abs(got[1] - 0.7) < 1e-12 and got[2] == 0.5 and abs(got[3] - 0.85) < 1e-12 and got[4] == got[5] == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_texts(docs, toxicity.learn(docs, labels)).collect()
    assert all(0 <= r["score"] < 0.7 for r in out)
    assert toxicity.score_texts(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0


TEXT = "Dr. Maria Garcia (maria.garcia@mail.example.com, +1 (386) 555-3733) met Anna Иванов; Ms. Garcia called 386-555-3733 from 42.144.35.254 with 4111 1111 1111 1111."


def test_surrogates(spark):
    rows = [(1, TEXT, 0), (2, None, 0), (3, "", 0), (4, "plain 12 words, no. 3-4", 0), (5, TEXT, 0), (6, "x " * 60_000 + "a.b@c.example.org", 0)]
    out = {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    new = out[1]["text"]
    assert out[1]["n_entities"] == 8 and out[5]["text"] == new and out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == rows[3][1]
    for gone in ("Maria", "Garcia", "386) 555", "42.144", "4111 1111 1111", "Anna", "Иванов"):
        assert gone not in new
    assert out[6]["n_entities"] == 1 and "a.b@c.example.org" not in out[6]["text"]
    again = pii.find_entities(new)
    assert [k for _, _, k in again] == [k for _, _, k in pii.find_entities(TEXT)]
    said = {k: [new[s:e] for s, e, kind in again if kind == k] for k in pii.KINDS}
    assert pii.luhn(said["card"][0].replace(" ", "")) == 0 and said["card"][0][4] == " "
    assert "".join(c for c in said["phone"][0] if c.isdigit())[1:] == said["phone"][1].replace("-", "")
    first, third = said["name"][0].split(), said["name"][2].split()
    assert first[1] in pii.GIVEN["latin", "f"] and first[2] == third[1] and said["name"][1].split()[1] in pii.SURNAMES["cyrillic"]


def test_permutations_are_one_to_one():
    for size in (2, 7, 100, 1000):
        assert sorted(pii.permute(v, size, b"k", "t") for v in range(size)) == list(range(size))
    seen = {pii.surrogate("ip", f"10.0.{a}.{b}") for a in range(8) for b in range(64)}
    assert len(seen) == 512
    assert len({pii.surrogate("email", f"a{i}.z@x.example.com") for i in range(500)}) == 500


def test_clashes_are_found(spark):
    pairs = spark.createDataFrame([("a", "x", "s"), ("a", "y", "s"), ("a", "z", "t"), ("b", "x", "s")], "kind string, entity string, surrogate string")
    assert [tuple(r) for r in pii.clashes(pairs).collect()] == [("a", "y")]


def test_no_surrogate_is_an_entity_or_another_surrogate(spark):
    """Full shapes: every one-letter address and one given name with every listed surname are in the corpus."""
    real = [f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{g} {s}" for g in pii.GIVEN["greek", "f"] for s in pii.SURNAMES["greek"]]
    real += ["Dr. 王伟", "+3865553733", "386-555-3733", "123-45-6789", pii.surrogate("ssn", "123-45-6789")]
    out = pii.replace_entities(spark.createDataFrame(list(enumerate(real)), "doc_id long, text string")).toPandas()
    assert (out["n_entities"] == 1).all() and len(out) == len(real)
    kinds = out["spans"].str.split(":").str[0]
    same = [(k, pii.canonical(k, t)) for k, t in zip(kinds, out["text"], strict=True)]
    assert not set(same) & {(k, pii.canonical(k, real[i])) for k, i in zip(kinds, out["doc_id"], strict=True)}
    # The two mentions of one telephone number may differ by their country code; all others are different entities.
    assert len(set(same)) >= len(real) - 1


def test_moved_entities_are_joined_or_broadcast_alike(spark):
    """Names of a full list clash; with no room in the plan they come by a join. Columns that clash stay."""
    rows = [(i, f"we met {g} {s} and {g} {s} again", "kept", 7, "new", "mark") for i, (g, s) in enumerate((g, s) for g in pii.GIVEN["greek", "f"] for s in pii.SURNAMES["greek"])]
    rows += [rows[0], (900, None, "kept", 7, "new", "mark"), (901, "", "kept", 7, "new", "mark"), (902, "x" * 100_000, "kept", 7, "new", "mark")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_entities int, new_text string, text_mark string")
    one, other = (pii.replace_entities(df, inline=n) for n in (pii.INLINE, 0))
    assert one.columns == other.columns == [*df.columns, "n_entities_", "spans_"]
    got = sorted(map(tuple, one.collect()), key=repr)
    assert got == sorted(map(tuple, other.collect()), key=repr)
    assert {r[2:6] for r in got} == {("kept", 7, "new", "mark")} and {r[6] for r in got} == {0, 2}
    assert pii.entity_pairs(df, "text", pii.KEY).count() == 80
    assert pii.settled_pairs(pii.entity_pairs(df, "text", pii.KEY), pii.KEY).filter("attempt > 0").count() > 0
    assert pii.replace_entities(df.limit(0)).collect() == []


def test_people_keep_one_surname_after_clashes(spark):
    """A dense corpus: listed given names times listed surnames, each with a mention by title; every full name clashes."""
    given, last = [*pii.GIVEN["latin", "f"][:12], *pii.GIVEN["latin", "m"][:12]], [*pii.SURNAMES["latin"][:20], "Qarvel", "Ostby"]
    people = [(g, s) for g in given for s in last]
    rows = [(i, f"we met {g} {s} and Mr. {s} too, then Dr. {g} {s}") for i, (g, s) in enumerate(people)]
    rows += [(5000 + i, f"{g} {s}") for i, (g, s) in enumerate((g, s) for g in pii.GIVEN["greek", "m"] for s in pii.SURNAMES["greek"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for inline in (pii.INLINE, 0):
        out = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, inline=inline).collect()}
        said = {}
        for i, (g, s) in enumerate(people):
            first, surname, alone, again = out[i].removeprefix("we met ").replace(" and Mr. ", " ").replace(" too, then Dr. ", " ").split(" ", 3)
            assert alone == surname and again == f"{first} {surname}"
            said[g, s] = first, surname
        assert len(set(said.values())) == len(people) and not set(said.values()) & set(people)
        assert len({n for _, n in said.values()}) == len(last) == len({(s, said[g, s][1]) for g, s in people})
        greek = {out[i] for i in out if i >= 5000}
        assert len(greek) == 80 and not greek & {t for i, t in rows if i >= 5000}
        assert len({t.split(" ")[1] for t in greek}) == len(pii.SURNAMES["greek"])
    assert pii.canonical("name", "Dr. Maria Garcia") == "Maria Garcia" and pii.canonical("name", "Ms. Garcia") == "Garcia"
