"""p7, p8, p9 on small corpora: exact round trips, targets, held-out labels."""

import os
import random

import numpy as np
import pytest

from gallerist.llm import mixing as X
from gallerist.llm import subjects as S
from gallerist.llm import tokens as T

PATH = os.path.join(T.TOKENIZERS, T.MODEL)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


def texts():
    rng = random.Random(0)
    words = ["face", "door's", "  ", "\t\n", "été", "门口的摄像头", "🙂", "123", "<|endoftext|>", "a" * 90, " ", "\r\n\r\n", "...", "x", "é"]
    long = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    return [None, "", " ", "\n", "short", "x" * 7000, " " * 3000 + "y" * 900 + "\t" * 1500 + "z", "汉" * 2500] + long


def test_encoding_equals_whole_texts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows] + [(4, "short", "x", 5)], "doc_id bigint, text string, ids string, k int")
    coded = T.encode_corpus(df, chunk=700, overlap=120)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    tok = T.tokenizer(PATH)
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == tok.encode(t or "", add_special_tokens=False).ids, i
    back = {r["doc_id"]: r["text"] for r in T.decode_corpus(coded).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert T.encode_corpus(df.limit(0)).count() == 0


def test_pieces_go_on_after_a_long_pre_token():
    text = "one two " + "x" * 3000 + " three four five six seven" * 40 + "  " * 300 + "end"
    chunks = [text[i : i + 150] for i in range(0, len(text), 100)]
    got = list(T.pieces_in_order([(7, c) for c in chunks] + [(8, "a b"), (9, "c")], 100, PATH))
    assert "".join(x for d, _, x in got if d == 8) == "a b" and got[-1] == (9, 0, "c")
    got = [{"k": n, "text": x} for d, n, x in got if d == 7]
    assert "".join(r["text"] for r in got) == text and [r["k"] for r in got] == list(range(len(got)))
    assert sum(len(r["text"]) > 700 for r in got) == 1  # only the long pre-token
    tok = T.tokenizer(PATH)
    assert sum((tok.encode(r["text"], add_special_tokens=False).ids for r in got), []) == tok.encode(text, add_special_tokens=False).ids


def test_mixture_meets_targets(spark):
    rng = random.Random(1)
    word = lambda n: " ".join(rng.choice(["face", "gate", "lens", "door"]) for _ in range(n))
    docs = [(i, word(rng.randrange(1, 60)), rng.choice(["a b", "A-B", "a_b "])) for i in range(400)] + [(i, word(rng.randrange(20, 90)), "c") for i in range(400, 500)] + [(500, None, "a b"), (501, "", "c"), (502, word(9), None), (503, word(9), "other")]
    targets = [("a_b", 2.0, 1), ("c", 1.0, 3), ("none of them", 5.0, 1), ("bad", None, 2), ("c", 9.0, 9)]
    d = spark.createDataFrame([(*x, 1.0) for x in docs + docs[:5]], "doc_id bigint, text string, source string, rate double")
    t = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    rows = X.mix(d, t).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and max(r["copies"] for r in rows if r["source"] == "c") <= 3 and max(r["copies"] for r in rows if r["source"] == "a_b") == 1
    sizes = {s: sum(r["copies"] * r["tokens"] for r in rows if r["source"] == s) for s in ("a_b", "c")}
    assert sizes["a_b"] / sum(sizes.values()) == pytest.approx(2 / 3, abs=0.01)
    exact = {s: sum(r["rate"] * r["tokens"] for r in rows if r["source"] == s) for s in ("a_b", "c")}
    assert exact["a_b"] == pytest.approx(sizes["a_b"], rel=0.02)
    report = {r["source"]: r for r in X.shares(X.mix(d, t), t).collect()}
    assert report["none of them"]["copies"] == 0 and report["none of them"]["actual_share"] is None
    big = X.mix(d, t, total=1e7).collect()
    assert {r["copies"] for r in big if r["source"] == "a_b"} == {1}
    assert X.mix(d.limit(0), t).count() == 0


AREAS = {
    "law": ["court", "statute", "appeal", "contract", "judge", "verdict", "clause", "consent"],
    "sport": ["goal", "stadium", "coach", "league", "referee", "match", "athlete", "medal"],
    "optics": ["lens", "aperture", "glare", "sensor", "tripod", "focus", "filter", "mount"],
}
PLAIN = ["the gallery was rebuilt after some persons left", "track three was reset after a gap again", "nothing was recalibrated on this split", "latency stayed near ten units per frame"]


def document(rng, areas):
    out = []
    for _ in range(rng.randrange(4, 9)):
        if areas and rng.random() < 0.6:
            a, b = rng.sample(AREAS[rng.choice(areas)], 2)
            out.append(rng.choice([f"we spoke of the {a} and then the {b} today", f"without a proper {a} the {b} could not go on", f"there were remarks on the {a} but none on the {b}"]))
        else:
            out.append(rng.choice(PLAIN))
    return "north gate · draft\n\n" + ". ".join(x.capitalize() for x in out) + ".\n\nEnd of note."


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(2)
    docs, truth, marks = [], {}, []
    for i in range(420):
        areas = rng.choice([[], ["law"], ["sport"], ["optics"], ["law", "optics"]])
        text = document(rng, areas)
        truth[i] = {a for a in AREAS if sum(any(w in s.split() for w in AREAS[a]) for s in text.lower().replace("\n", ". ").split(". ")) >= 2}
        docs.append((i, text, "en", "x"))
        if i < 260:
            marks += [(i, a.upper() if i % 7 == 0 else a + " ", "an") for a in sorted(truth[i])] or [(i, "None", "an")]
    docs += [(900, None, None, "x"), (901, "", "en", "x"), (902, " \n ", "zz", "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, subject string")
    areas = spark.createDataFrame([(a, "") for a in AREAS] + [(None, "")], "subject string, description string")
    labels = spark.createDataFrame(marks + [(5, "nonsense", "an"), (None, "law", "an")], "doc_id bigint, subject string, annotator string")
    got: dict = {}
    rows = S.subject_areas(d, areas, labels).collect()
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert len(rows) == len(set(rows)) and not {900, 901, 902} & set(got)
    held = range(260, 420)
    assert sum(got.get(i, set()) == truth[i] for i in held) / len(held) >= 0.9
    assert S.subject_areas(d, areas, labels.limit(0)).count() == 0


def test_sentences():
    n = S._Numbers()
    count = lambda text: len(S.parsed(text, n)[1])
    assert S.parsed(None, n) == S.parsed(" \n ", n) == ([], [], [], []) and count("## Remarks\n{\"event\": 1}\n") == 0
    assert count("- One two three four. Monday. Five six seven eight!\n[10:03] ana: nine ten eleven twelve") == 3
    assert S.sentences_of("轨迹在中断之后被重置。经过三帧，状态未确认。")[0] == list("轨迹在中断之后被重置")
    assert S.mended("Ã©tat n'Ã©tait") == "état n'était" and S.mended("état") == "état"
    assert S.tokens_of("L'Été\U0001d165 naïf") == ["l'ete", "naif"]
    # a first line without any mark is a header, unless it is all there is
    assert count("old mill · open draft of the pilot\nOne two three four.") == 1 == count("old mill · open draft of the pilot")
    # lines without letters don't count
    assert S.parsed("-----\nOne two three four.\n🙂", n)[2:] == ([0], [S.parsed("one TWO three four", n)[3][0]])


def test_sentences_of_batches_against_single_texts():
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["One two three four. Five six seven eight!", "nine ten", "End of the note here.", "## x", ""]) for _ in range(rng.randrange(6))) for _ in range(50)]
    n = S._Numbers()
    rows = [S.parsed(t, n) for t in texts]
    import pyarrow as pa

    first, last = [rng.choice([True, None]) for _ in rows], [rng.choice([True, False, None]) for _ in rows]
    batch = pa.record_batch([pa.array([r[i] for r in rows], pa.list_(k)) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))] + [pa.array(first, pa.bool_()), pa.array(last, pa.bool_())], ["words", "sizes", "places", "lines", "first_out", "last_out"])
    s = S.opened(batch)
    want = []
    for d, (words, sizes, places, lines) in enumerate(rows):
        at = 0
        for z, p in zip(sizes, places):
            if not (first[d] and p == 0 or last[d] and p == len(lines) - 1):
                want.append((d, words[at : at + z]))
            at += z
    starts = s.starts
    assert [(int(d), s.words[a : a + z].tolist()) for d, a, z in zip(s.doc, starts, s.sizes)] == want
    half = s.take(np.arange(len(texts)) % 2 == 0)
    assert [(2 * int(d), half.words[a : a + z].tolist()) for d, a, z in zip(half.doc, half.starts, half.sizes)] == [w for w in want if w[0] % 2 == 0]


def test_entropies_are_per_token():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 9, 40)
    s = S.Sentences(rng.integers(0, 1 << 31, sizes.sum()).astype(np.int32), sizes, np.arange(40) // 4)
    h = S.hashed(s, S.language_table(rng.random((S.UNI, 2))))
    m = S.Models(*S.counted(h, rng.random((40, 3)), 2))
    one, twice = m.entropies(h), S.Hashed(h.lang.repeat(2), *(np.concatenate([np.tile(x[a : a + z], 2) for a, z in zip(s.starts, sizes)]) for x in (h.uni, h.bi)), sizes.repeat(2), h.doc.repeat(2))
    assert np.allclose(m.entropies(twice)[::2], one, rtol=1e-5)
    assert np.allclose(m.evidence(h), (one[:, 2:] - one) * sizes[:, None], rtol=1e-5) and (m.evidence(h)[:, 2] == 0).all()


@pytest.mark.parametrize("others", [0, 3_000])
def test_boilerplate_is_told_by_source(spark, others):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    body = lambda: "\n".join(" ".join(word() for _ in range(5)) + "." for _ in range(3))
    rows = [(i, body() + ("\nEnd of NOTE 🙂." if i % 4 == 0 else ""), "en", "s") for i in range(200)]
    rows += [(1000 + i, "Copied first line.\nand a second one.", "en", "s") for i in range(30)]  # one text, often
    rows += [(2000 + i, body(), "en", "big") for i in range(others)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "xxhash64(text) AS text_key")
    docs = d.select("doc_id", "lang", "source", "text_key", "text").mapInArrow(S._parse, S.PARSED)
    assert [r["key"] for r in S.boilerplate_lines(docs).collect()] == [S.parsed("end of note", S._Numbers())[3][0]]


def test_rare_languages_have_models(spark):
    rows = [(i, "the gate is open today.", "en", "s") for i in range(900)] + [(1000 + i, "brama jest dzis otwarta.", "pl", "s") for i in range(6)] + [(2000, "x y z w", "qq", "s"), (2001, "x", None, "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "xxhash64(text) AS text_key")
    table = S.language_words(d.select("doc_id", "lang", "source", "text_key", "text").mapInArrow(S._parse, S.PARSED))
    n = S._Numbers()
    words = lambda x: np.array([n[w] for w in x.split()]) % S.UNI
    assert table.shape[1] == 2 and table[words("brama jest")].sum(axis=0).argmax() == 1 and table[words("gate open")].sum(axis=0).argmax() == 0


def test_all_labelled_documents_are_fitted_on(spark):
    rng = random.Random(8)

    def text(area, sentences):
        own = lambda: "we spoke of the {} and then the {} today".format(*rng.sample(AREAS[area], 2))
        return " ".join((own() if i % 2 else rng.choice(PLAIN)).capitalize() + "." for i in range(sentences))

    names = sorted(AREAS)
    # of the first area only long texts are labelled
    docs = [(i, text(names[0], 260), "en", "s", names[0]) if i % 4 == 0 else (i, text(names[i % 2 + 1], 6), "en", "s", names[i % 2 + 1]) for i in range(80)]
    docs += [(100 + i, text(names[0], 6), "en", "s", None) for i in range(20)]
    d = spark.createDataFrame([x[:4] for x in docs], "doc_id bigint, text string, lang string, source string")
    areas = spark.createDataFrame([(a, "") for a in names], "subject string, description string")
    labels = spark.createDataFrame([(x[0], x[4]) for x in docs if x[4]], "doc_id bigint, subject string")
    got = {(r["doc_id"], r["subject"]) for r in S.subject_areas(d, areas, labels).collect()}
    assert sum((100 + i, names[0]) in got for i in range(20)) >= 18
    # the same whatever the number of tasks
    assert {(r["doc_id"], r["subject"]) for r in S.subject_areas(d.repartition(3), areas, labels).collect()} == got
