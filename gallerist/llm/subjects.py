"""Subject areas of documents.

Method: one interpolated n-gram language model for each subject and one for
the background (talk about the recognition itself, log excerpts, small talk)
give every sentence a per-token cross-entropy.  The models start from what the
documents of an area have beyond the others and are trained by expectation
maximisation: a sentence of a labelled document comes from one of its labelled
subjects or the background, with a small share for mistakes.  What a subject
saves per token against the background, times the tokens, is its evidence;
with the document's own mix as prior it gives posteriors.  A sentence deals
with a subject if its posterior passes the subject's level, which is calibrated
on held-out labels, and a document has every subject that two of its sentences
deal with, or one in a text of up to three.

Counts are kept in hashed tables of fixed size (``UNI`` words, ``BI`` pairs,
for each class), so that what is broadcast and collected is bounded whatever
the corpus.  The models and levels come from all labelled documents, whole,
which are counted where they lie, round by round; the lines that are greeting,
header or footer and the words of the languages are found in all documents,
and all are classified whole.

Scale: texts are parsed once, into numbers of words by sentence, which are
written to shared storage; what follows works on arrays of whole batches.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.functions.text import folded
from gallerist.storage import materialize

UNI, BI = 1 << 16, 1 << 18
#: Rows of the tables of words and pairs that are summed by one task at once.
SLICE = 1 << 14
#: Bytes of word tables (pairs take four times as much) that a task keeps for
#: the languages before it sends them on.
HELD_BYTES = 48 << 20
#: Interpolation: shares of class and all text for words; of the class's pairs,
#: all pairs and words for pairs.
WORD, PAIR = (0.5, 0.5), (0.1, 0.1, 0.8)
#: A line is boilerplate if it begins or ends this share of the different texts
#: of a source, and at least so many, and is found there this often when it occurs.
EDGE_SHARE, EDGE_TEXTS, EDGE_ALWAYS = 0.01, 5, 0.9
#: Documents that name a language before it gets a model of its own, and models
#: at most (256 kB each); text in another language goes to the nearest.
SPOKEN, LANGUAGES = 5, 128
MISTAKE = 0.03
SHORT_TEXT = 3
#: Prior of an area against the background in a document without labels.
AREA_PRIOR = 0.1
#: Posteriors that calibration chooses from, for each subject.
LEAST = (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)
#: Likelihood exponents of the rounds on labelled documents.
HEATS = (0.5, 1.0, 1.0)


class _Without:
    """Takes the characters of some Unicode categories out of a text.  Those of
    the first plane are a regular-expression class; others are looked up."""

    def __init__(self, *categories: str):
        self.categories = categories
        chars = [i for i in range(0x10000) if i not in (9, 10) and unicodedata.category(chr(i)) in categories]
        self.plane = re.compile("[" + "".join(f"\\u{i:04x}" for i in chars) + "]+")

    def __call__(self, text: str) -> str:
        text = self.plane.sub("", text)
        if _BEYOND.search(text):
            text = "".join(c for c in text if c < "\U00010000" or unicodedata.category(c) not in self.categories)
        return text


_TAG = re.compile(r"<[^<>]{1,200}>")
_LEAD = re.compile(r"\s*(?:#+\s|[-*•·>]\s+|\(?\d{1,3}[.)]\s+|\[\d{1,2}:\d{2}\]\s*[^\s:]{1,20}\s*:|[QA]:\s)\s*")
_END = re.compile(r"(?:(?<=[.!?])[\"'»”)\]]*\s+|(?<=[。！？])[”」』）)]*\s*)")
_STOP = re.compile(r"[.!?。！？…:;]")
_WORD = re.compile(r"[㐀-鿿぀-ヿ가-힯]|[^\W\d_]+(?:['’][^\W\d_]+)*")
_BROKEN = re.compile("[ÃÂâ][\x80-\xbf¡-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[Ãã][a-z©¨¤¶¼±]")
_BEYOND, _CONTROL = re.compile("[\U00010000-\U0010ffff]"), re.compile(r"[\x00-\x08\x0b-\x1f\x7f]+")
_visible, _unmarked = _Without("Cf", "Cc"), _Without("Mn")
_NO_LETTER, _LETTER = re.compile(r"[\W\d_]+"), re.compile(r"[^\W\d_]")


def mended(text: str) -> str:
    """UTF-8 that was read as a one-byte code, line by line; else unchanged."""
    if not _BROKEN.search(text):
        return text
    out = []
    for line in text.split("\n"):
        if _BROKEN.search(line):
            for code in ("cp1252", "latin-1"):
                try:
                    line = line.encode(code).decode("utf-8")
                    break
                except UnicodeError:
                    continue
            else:
                raw = b"".join(c.encode("cp1252", "ignore") or c.encode("latin-1", "ignore") if ord(c) > 127 else c.encode() for c in line)
                line = raw.decode("utf-8", "ignore")
        out.append(line)
    return "\n".join(out)


def lines_of(text: str) -> list[str]:
    """Non-blank lines without markup and invisible characters."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    plain = text.isascii()
    if not plain:
        text = mended(text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
        plain = text.isascii()
    text = _CONTROL.sub("", text) if plain else _visible(unicodedata.normalize("NFKC", text))
    return [x for x in map(str.strip, text.split("\n")) if x]


def line_key(line: str) -> str:
    """Letters of a line, for telling boilerplate; of a long one all characters."""
    return _NO_LETTER.sub("", line.casefold()) if len(line) <= 200 else line


def tokens_of(sentence: str) -> list[str]:
    """Case-folded words without accents; every CJK character is a word."""
    sentence = sentence.casefold()
    if not sentence.isascii() and (apart := unicodedata.normalize("NFD", sentence)) != sentence:
        sentence = _unmarked(apart)
    return _WORD.findall(sentence)


def sentences_of(line: str) -> list[list[str]]:
    """Token lists of the sentences of a line.

    A heading or a structured record has none; a fragment of up to three words
    belongs to the sentence after it (or before it, at the end of the line).
    """
    if line[0] == "#" or line[0] == "{":
        return []
    for _ in range(2):
        if (lead := _LEAD.match(line)) is not None:
            line = line[lead.end() :]
    out: list[list[str]] = []
    held: list[str] = []
    for part in _END.split(line):
        held = held + tokens_of(part) if held else tokens_of(part)
        if len(held) > 3:
            out.append(held)
            held = []
    if held:
        if out:
            out[-1] = out[-1] + held
        elif len(held) > 1:
            out.append(held)
    return out


class _Numbers(dict):
    """31-bit numbers of words, kept for the next time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "replace")) >> 1
        return out


def parsed(text: str | None, numbers: _Numbers) -> tuple[list[int], list[int], list[int], list[int]]:
    """A text in numbers: its words, the words of each sentence, the line of
    each sentence, and a 64-bit key of each line.

    Lines without letters don't count.  The first line of a text of several is
    a header if no mark ends or divides it.
    """
    from xxhash import xxh3_64_intdigest

    words, sizes, places, keys = [], [], [], []
    lines = [(x, line_key(x)) for x in lines_of(text or "") if _LETTER.search(x)]
    for n, (line, key) in enumerate(lines):
        keys.append(xxh3_64_intdigest(key.encode("utf-8", "replace")) - (1 << 63))
        if n == 0 and len(lines) > 1 and not _STOP.search(line):
            continue
        for sentence in sentences_of(line):
            words += [numbers[w] for w in sentence]
            sizes.append(len(sentence))
            places.append(n)
    return words, sizes, places, keys


PARSED = "doc_id bigint, lang string, source string, text_key bigint, words array<int>, sizes array<int>, places array<int>, lines array<bigint>"


def _parse(batches):
    numbers = _Numbers()
    for batch in batches:
        rows = [parsed(t, numbers) for t in batch.column("text").to_pylist()]
        lists = [pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.record_batch([batch.column(c) for c in ("doc_id", "lang", "source", "text_key")] + lists, ["doc_id", "lang", "source", "text_key", "words", "sizes", "places", "lines"])


class Sentences(NamedTuple):
    """Sentences of several documents, one after another."""

    words: np.ndarray  #: numbers of all words
    sizes: np.ndarray  #: words of each sentence
    doc: np.ndarray  #: document of each sentence, ascending

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def take(self, docs: np.ndarray) -> Sentences:
        """The sentences of a mask of documents, which are numbered anew."""
        keep = docs[self.doc]
        return Sentences(self.words[np.repeat(keep, self.sizes)], self.sizes[keep], (np.cumsum(docs) - 1)[self.doc[keep]])


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def opened(batch) -> Sentences:
    """Sentences of a batch of parsed texts, without those in boilerplate at
    the ends (``first_out``, ``last_out``)."""
    words, _ = _flat(batch.column("words"))
    sizes, counts = _flat(batch.column("sizes"))
    places, _ = _flat(batch.column("places"))
    _, lines = _flat(batch.column("lines"))
    doc = np.repeat(np.arange(len(counts)), counts)
    out = lambda c: np.asarray(batch.column(c).fill_null(False).to_numpy(zero_copy_only=False), bool)[doc]
    drop = (out("first_out") & (places == 0)) | (out("last_out") & (places == lines[doc] - 1))
    keep, sizes = ~drop, sizes.astype(np.int64)
    return Sentences(words[np.repeat(keep, sizes)], sizes[keep], doc[keep])


def language_table(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of words in each language from (word, language) counts."""
    return np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * UNI)).astype(np.float32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit hash of two numbers."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64) * np.uint64(0x85EBCA77) + np.uint64(0x165667B1)) & np.uint64(0xFFFFFFFF)
    h ^= h >> np.uint64(15)
    h = (h * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return h ^ (h >> np.uint64(13))


class Hashed(NamedTuple):
    """Table places of sentences: language, and word and pair of each token."""

    lang: np.ndarray
    uni: np.ndarray
    bi: np.ndarray
    sizes: np.ndarray
    doc: np.ndarray

    def take(self, docs: np.ndarray) -> Hashed:
        keep = docs[self.doc]
        tokens = np.repeat(keep, self.sizes)
        return Hashed(self.lang[keep], self.uni[tokens], self.bi[tokens], self.sizes[keep], (np.cumsum(docs) - 1)[self.doc[keep]])


def hashed(s: Sentences, languages: np.ndarray) -> Hashed:
    """Most likely language of each sentence, and the places of its words and
    of their pairs with the word before, in that language."""
    if not len(s.sizes):
        return Hashed(*(np.zeros(0, np.int64) for _ in range(3)), s.sizes, s.doc)
    lang = np.add.reduceat(languages[s.words % UNI], s.starts, axis=0).argmax(axis=1)
    salt = np.repeat(lang + 1, s.sizes)
    h = _mixed(s.words, salt)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[s.starts] = (lang + 1).astype(np.uint64)
    return Hashed(lang, (h % np.uint64(UNI)).astype(np.int64), (_mixed(before, h) % np.uint64(BI)).astype(np.int64), s.sizes, s.doc)


class Models:
    """Probabilities of hashed words and pairs for each class.

    The last class is the background.  A class's text in another language
    says nothing about a sentence, so all shares are relative to the class's
    text in the language of the sentence.  All weights of the interpolation
    are fixed, so that a class with little text is not at a disadvantage: a
    pair's probability mixes that in the class, that in all text, and the
    word's, which again mixes class and all text.
    """

    def __init__(self, uni: np.ndarray, bi: np.ndarray, totals: np.ndarray):
        self.uni, self.bi, self.totals = (x.astype(np.float32) for x in (uni, bi, totals))
        self.all_uni, self.all_bi, self.all_totals = (x.sum(axis=1, keepdims=True) for x in (self.uni, self.bi, self.totals))

    def entropies(self, s: Hashed) -> np.ndarray:
        """Cross-entropy per token of sentences (rows) under each class."""
        out = np.empty((len(s.sizes), self.uni.shape[1]), np.float32)
        ends = np.cumsum(s.sizes)
        a = 0
        while a < len(s.sizes):  # pieces of about 16,384 tokens
            begin = ends[a] - s.sizes[a]
            b = max(a + 1, int(np.searchsorted(ends, begin + 16_384, "right")))
            out[a:b] = self._piece(s.lang[a:b], s.uni[begin : ends[b - 1]], s.bi[begin : ends[b - 1]], s.sizes[a:b])
            a = b
        return out

    def _piece(self, lang, uni, bi, sizes) -> np.ndarray:
        starts = np.cumsum(sizes) - sizes
        tokens = np.repeat(lang, sizes)
        word, word_all = self.uni[uni], self.all_uni[uni]
        p = word / np.maximum(self.totals, 20.0)[tokens]
        p *= PAIR[2] * WORD[0]
        p += (PAIR[2] * WORD[1]) * (word_all + 0.02) / (self.all_totals + 100.0)[tokens]
        pair, pair_all = self.bi[bi], self.all_bi[bi]
        p += (PAIR[1] * pair_all) / np.maximum(np.maximum(_shifted(word_all, starts, self.all_totals[lang] * 0.1), pair_all), 0.5)
        p += PAIR[0] * pair / np.maximum(np.maximum(_shifted(word, starts, self.totals[lang] * 0.1), pair), 0.5)
        return np.add.reduceat(-np.log(p), starts, axis=0) / sizes[:, None]

    def evidence(self, s: Hashed) -> np.ndarray:
        """What each class saves against the background: per token, times tokens."""
        if not len(s.sizes):
            return np.zeros((0, self.uni.shape[1]), np.float32)
        h = self.entropies(s)
        return (h[:, -1:] - h) * s.sizes[:, None].astype(np.float32)


def _shifted(seen: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of the word before; at the start of a sentence ``first``."""
    out = np.empty_like(seen)
    out[1:] = seen[:-1]
    out[starts] = first
    return out


def posteriors(evidence: np.ndarray, doc: np.ndarray, prior: np.ndarray, adapt: bool, heat: float = 1.0) -> np.ndarray:
    """Class weights of sentences (rows) under the prior of their document
    (rows of ``prior``), which is re-estimated from the document itself if
    ``adapt``.  ``heat`` below one flattens the likelihoods."""
    like = np.exp(heat * (evidence - evidence.max(axis=1, keepdims=True)), dtype=np.float32)
    now = prior.astype(np.float32)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    for _ in range(4 if adapt else 1):
        w = like * now[doc]
        w /= w.sum(axis=1, keepdims=True)
        if adapt and len(doc):
            now = 0.5 * prior / prior.sum(axis=1, keepdims=True)
            now[doc[starts]] += np.add.reduceat(w, starts, axis=0)
            now = (now / now.sum(axis=1, keepdims=True)).astype(np.float32)
    return w


def counted(s: Hashed, weights: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, pair and total counts of sentences with class weights."""
    classes = weights.shape[1]
    uni, bi, totals = np.zeros((UNI, classes), np.float32), np.zeros((BI, classes), np.float32), np.zeros((languages, classes), np.float32)
    for c in np.flatnonzero(weights.sum(axis=0)):
        some = np.flatnonzero(weights[:, c] > 1e-6)
        sizes = s.sizes[some]
        at = np.repeat((np.cumsum(s.sizes) - s.sizes)[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        w = np.repeat(weights[some, c], sizes)
        uni[:, c] = np.bincount(s.uni[at], w, UNI)
        bi[:, c] = np.bincount(s.bi[at], w, BI)
        totals[:, c] = np.bincount(s.lang[some], weights[some, c] * sizes, languages)
    return uni, bi, totals


def excess(own: np.ndarray, exposure: np.ndarray) -> np.ndarray:
    """What documents of an area have beyond the others, of one language.

    ``own`` counts words or pairs (rows) in the documents of each area and, in
    the last column, in all labelled ones; ``exposure`` has the column sums.
    An area has its counts less what is expected from the rate in labelled
    documents without that area and its chance variation; the background, in
    the last column, has the rest.
    """
    if not exposure[-1]:
        return np.zeros_like(own)
    area, whole = own[:, :-1], own[:, -1:]
    expected = (whole - area) * (exposure[:-1] / np.maximum(exposure[-1] - exposure[:-1], 1.0))
    out = np.maximum(0.0, area - expected - np.sqrt(np.maximum(expected, 0.0)))
    out = out / np.maximum(1.0, out.sum(axis=1, keepdims=True) / np.maximum(whole, 1e-9))
    return np.concatenate([out, whole - out.sum(axis=1, keepdims=True)], axis=1)


PARTS = "lang int, slice int, fold int, blob binary"


def _parts(lang: int, fold: int, table: np.ndarray, totals: bool):
    """Batches with the rows of a table that are not zero, slice by slice;
    ``totals`` have slice -1."""
    some = np.flatnonzero(table.any(axis=1))
    out: list[tuple[int, bytes]] = []
    for k in np.unique(some // SLICE).tolist():
        at = some[some // SLICE == k]
        out.append((-1 if totals else k, at.astype("<i4").tobytes() + table[at].astype("<f4").tobytes()))
    n = len(out)
    yield pa.record_batch([pa.array([lang] * n, pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([fold] * n, pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["lang", "slice", "fold", "blob"])


def _add(table: np.ndarray, blob: bytes, first: int = 0) -> None:
    """Add the rows that ``blob`` has of a table beginning at row ``first``."""
    n = len(blob) // (4 + 4 * table.shape[1])
    table[np.frombuffer(blob[: 4 * n], "<i4") - first] += np.frombuffer(blob[4 * n :], "<f4").reshape(n, -1)


def _merged(parts: DataFrame, classes: int, rows: int, sets: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tables (words and pairs, ``rows`` totals) of each set, summed slice by slice."""

    def run(batches):
        for batch in batches:
            for k, fold, blobs in zip(*(batch.column(c).to_pylist() for c in ("slice", "fold", "blobs"))):
                first = max(k, 0) * SLICE
                table = np.zeros((rows if k < 0 else SLICE, classes))
                for blob in sorted(blobs):  # the same sum in any order of arrival
                    _add(table, blob, first)
                at = np.flatnonzero(table.any(axis=1))
                yield pa.record_batch([pa.array([0], pa.int32()), pa.array([k], pa.int32()), pa.array([fold], pa.int32()), pa.array([(at + first).astype("<i4").tobytes() + table[at].astype("<f4").tobytes()], pa.binary())], ["lang", "slice", "fold", "blob"])

    out = [(np.zeros((UNI + BI, classes), np.float32), np.zeros((rows, classes), np.float32)) for _ in range(sets)]
    summed = parts.groupBy("slice", "fold").agg(F.collect_list("blob").alias("blobs")).mapInArrow(run, PARTS).select("slice", "fold", "blob").toArrow()
    for k, fold, blob in zip(*(summed.column(c).to_pylist() for c in ("slice", "fold", "blob"))):
        _add(out[fold][k < 0], blob)
    return out


class Fitting:
    """Models of labelled documents, fitted where these lie.

    ``known`` has parsed documents with ``fold`` (0 or 1) and ``areas``, the
    numbers of their subjects.  Three models are fitted side by side: 0 and 1
    without the documents of that fold, to choose levels with, and 2 on all.
    """

    def __init__(self, known: DataFrame, subjects: int, languages: np.ndarray):
        self.spark = known.sparkSession
        # a task sums all its documents before it sends a table on
        self.known = known.coalesce(self.spark.sparkContext.defaultParallelism)
        self.subjects, self.words, self.languages = subjects, self.spark.sparkContext.broadcast(languages), languages.shape[1]

    def _opener(self):
        words, subjects = self.words, self.subjects

        def open_(batch):
            labels = np.zeros((batch.num_rows, subjects), bool)
            areas, sizes = _flat(batch.column("areas"))
            labels[np.repeat(np.arange(batch.num_rows), sizes), areas] = True
            return hashed(opened(batch), words.value), labels, batch.column("fold").to_numpy()

        return open_

    def start(self) -> list[Models]:
        """First models: the excess of each area, language by language."""
        open_, languages, classes = self._opener(), self.languages, self.subjects + 1

        def count(batches):
            held: dict = {}
            for batch in batches:
                s, labels, fold = open_(batch)
                whole = np.concatenate([labels, np.ones((len(labels), 1), bool)], axis=1)  # in the last class: all documents
                for f in (0, 1):
                    for lang in np.unique(s.lang).tolist():
                        weights = whole[s.doc].astype(float) * ((s.lang == lang) & (fold[s.doc] == f))[:, None]
                        uni, bi, totals = counted(s, weights, languages)
                        if (lang, f) in held:
                            held[lang, f][0] += np.concatenate([uni, bi])
                            held[lang, f][1] += totals
                        else:
                            held[lang, f] = [np.concatenate([uni, bi]), totals]
                        if len(held) * uni.nbytes > HELD_BYTES:
                            yield from emptied(held)
            yield from emptied(held)

        def emptied(held):
            for (lang, f), (table, totals) in held.items():
                yield from _parts(lang, f, table, False)
                yield from _parts(lang, f, totals, True)
            held.clear()

        parts = materialize(self.known.mapInArrow(count, PARTS), "counts")
        exposure = [t for _, t in _merged(parts.filter("slice < 0"), classes, languages, 2)]
        by_set = [exposure[1], exposure[0], exposure[0] + exposure[1]]

        def settle(batches):
            for batch in batches:
                for lang, k, folds, blobs in zip(*(batch.column(c).to_pylist() for c in ("lang", "slice", "folds", "blobs"))):
                    own = np.zeros((2, SLICE, classes))
                    for f, blob in sorted(zip(folds, blobs)):
                        _add(own[f], blob, k * SLICE)
                    for n, table in enumerate((own[1], own[0], own[0] + own[1])):
                        got = np.zeros((SLICE * (k + 1), classes), np.float32)
                        got[SLICE * k :] = excess(table, by_set[n][lang].astype(float))
                        yield from _parts(lang, n, got, False)
                        if k * SLICE < UNI:
                            totals = np.zeros((languages, classes))
                            totals[lang] = got.sum(axis=0, dtype=float)
                            yield from _parts(lang, n, totals, True)

        whole = parts.filter("slice >= 0").groupBy("lang", "slice").agg(F.collect_list("fold").alias("folds"), F.collect_list("blob").alias("blobs"))
        return [self._model(*x) for x in _merged(whole.mapInArrow(settle, PARTS), classes, languages)]

    @staticmethod
    def _model(table: np.ndarray, totals: np.ndarray) -> Models:
        return Models(table[:UNI], table[UNI:], totals)

    def round(self, models: list[Models], heat: float) -> list[Models]:
        """Expectation and maximisation once over all labelled documents."""
        open_, languages, classes = self._opener(), self.languages, self.subjects + 1
        shared = self.spark.sparkContext.broadcast([(m.uni, m.bi, m.totals) for m in models])

        def count(batches):
            now = [Models(*x) for x in shared.value]
            sums = [[np.zeros((UNI + BI, classes), np.float32), np.zeros((languages, classes), np.float32)] for _ in now]
            for batch in batches:
                s, labels, fold = open_(batch)
                prior = np.where(np.concatenate([labels, np.ones((len(labels), 1), bool)], axis=1), 1.0, MISTAKE / classes)
                for n, model in enumerate(now):
                    use = fold != n
                    own = s.take(use)
                    if len(own.sizes):
                        uni, bi, totals = counted(own, posteriors(model.evidence(own), own.doc, prior[use], False, heat), languages)
                        sums[n][0][:UNI] += uni
                        sums[n][0][UNI:] += bi
                        sums[n][1] += totals
            for n, (table, totals) in enumerate(sums):
                yield from _parts(0, n, table, False)
                yield from _parts(0, n, totals, True)

        out = [self._model(*x) for x in _merged(self.known.mapInArrow(count, PARTS), classes, languages)]
        shared.destroy()
        return out

    def levels(self, models: list[Models]) -> np.ndarray:
        """For each subject, the posterior of ``LEAST`` from which a sentence
        counts: the one that answers most documents as labelled, each by the
        models of the other half.  The answers on all subjects count thrice as
        much as its own, as a subject may have few labels."""
        open_, subjects = self._opener(), self.subjects
        shared = self.spark.sparkContext.broadcast([(m.uni, m.bi, m.totals) for m in models[:2]])

        def count(batches):
            now, right = [Models(*x) for x in shared.value], np.zeros((len(LEAST), subjects), np.int64)
            for batch in batches:
                s, labels, fold = open_(batch)
                for f, model in enumerate(now):
                    test = fold == f
                    own = s.take(test)
                    evidence = model.evidence(own)
                    for k, least in enumerate(LEAST):
                        right[k] += (accepted(evidence, own.doc, int(test.sum()), least) == labels[test]).sum(axis=0)
            yield pa.record_batch([pa.array([right.ravel().tolist()], pa.list_(pa.int64()))], ["right"])

        got = self.known.mapInArrow(count, "right array<bigint>").toArrow().column("right").to_pylist()
        shared.destroy()
        right = np.array(got, float).sum(axis=0).reshape(len(LEAST), subjects)
        right += 3 * right.mean(axis=1, keepdims=True) - np.abs(np.array(LEAST) - 0.9)[:, None] * 1e-3
        return np.array(LEAST)[right.argmax(axis=0)]


def accepted(evidence: np.ndarray, doc: np.ndarray, docs: int, least) -> np.ndarray:
    """Mask (documents x subjects) of accepted subjects; ``least`` is a level
    or one for each subject."""
    classes = evidence.shape[1]
    prior = np.full((docs, classes), AREA_PRIOR)
    prior[:, -1] = 1.0
    if not len(doc):
        return np.zeros((docs, classes - 1), bool)
    hit = posteriors(evidence, doc, prior, True)[:, :-1] > least
    n = np.zeros((docs, classes - 1), np.int64)
    np.add.at(n, doc, hit)
    short = np.bincount(doc, minlength=docs) <= SHORT_TEXT
    return n >= np.where(short, 1, 2)[:, None]


def _unique(documents: DataFrame) -> DataFrame:
    """One row for each doc_id; without a ``source`` column all are of one source."""
    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lower(F.trim("lang")).alias("lang"), F.lower(F.trim(source)).alias("source"))
    return rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("text", "lang", "source")).alias("r")).select("doc_id", "r.text", "r.lang", "r.source")


def boilerplate_lines(docs: DataFrame) -> DataFrame:
    """``key`` of the greeting, header and footer lines: lines that begin or
    end at least ``EDGE_SHARE`` (and ``EDGE_TEXTS``) of the different texts of
    several lines of some source, and are hardly found elsewhere."""
    several = docs.filter(F.size("lines") > 1)
    first, last = F.element_at("lines", 1), F.element_at("lines", -1)
    edges = several.select("source", "text_key", F.explode(F.array_distinct(F.array(first, last))).alias("key"))
    texts = several.groupBy("source").agg(F.countDistinct("text_key").alias("texts"))
    often = edges.groupBy("source", "key").agg(F.countDistinct("text_key").alias("n")).filter(F.col("n") >= EDGE_TEXTS)
    some = often.alias("o").join(texts.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).filter(F.col("n") >= EDGE_SHARE * F.col("texts"))
    some = materialize(some.select("key").distinct(), "edges")
    spread = several.select(first.alias("first"), last.alias("last"), F.explode(F.array_distinct("lines")).alias("key")).join(some, "key")
    n = spread.groupBy("key").agg(F.count("*").alias("n"), F.count_if((F.col("first") == F.col("key")) | (F.col("last") == F.col("key"))).alias("edge"))
    return n.filter(F.col("edge") >= EDGE_ALWAYS * F.col("n")).select("key")


def without_edges(docs: DataFrame) -> DataFrame:
    """Parsed documents with ``first_out`` and ``last_out``, whether their first
    and last line is boilerplate."""
    lines = materialize(boilerplate_lines(docs), "boilerplate")
    several = F.size("lines") > 1
    rows = docs.withColumn("first", F.when(several, F.element_at("lines", 1))).withColumn("last", F.when(several, F.element_at("lines", -1)))
    rows = rows.join(lines.select(F.col("key").alias("first"), F.lit(True).alias("first_out")), "first", "left")
    return rows.join(lines.select(F.col("key").alias("last"), F.lit(True).alias("last_out")), "last", "left").drop("first", "last")


def language_words(docs: DataFrame) -> np.ndarray:
    """Log word probabilities of the languages that ``lang`` names."""
    spoken = docs.filter(F.col("lang").rlike("^[a-z]{2}$")).groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= SPOKEN)
    names = sorted(r["lang"] for r in spoken.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not names:
        return np.zeros((UNI, 1), np.float32)

    def run(batches):
        counts = np.zeros(len(names) * UNI, np.int64)
        for batch in batches:
            words, sizes = _flat(batch.column("words"))
            lang = np.repeat(batch.column("place").to_numpy(), sizes)
            counts += np.bincount(lang * UNI + words % UNI, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["at", "n"])

    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1
    rows = docs.filter(F.col("lang").isin(names)).select("words", place.alias("place")).mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(names) * UNI)
    table[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return language_table(table.reshape(len(names), UNI).T)


def subject_areas(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, subject)``: the areas of each document.

    Hand labels are folded and matched to ``areas``; a label "none" says that
    a document has no area, and other unknown labels are ignored.  All
    labelled documents are used for fitting, and every document is classified
    by its whole text.  Null, empty and blank texts have no area; a repeated doc_id
    counts once.  Without labels or areas the result is empty.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, subject string"
    names = sorted(r["subject"] for r in areas.select("subject").filter("subject IS NOT NULL").distinct().collect())
    whole = _unique(documents)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), folded("subject").alias("key")).filter("key IS NOT NULL")
    if not names or marks.isEmpty():
        return spark.createDataFrame([], schema)
    texts = whole.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_key"), "text", F.char_length("text").alias("chars")).filter("chars > 0")
    docs = materialize(texts.select("doc_id", "lang", "source", "text_key", "text").mapInArrow(_parse, PARSED), "parsed")
    docs = without_edges(docs)
    languages = language_words(docs)
    key = {"".join(n.casefold().split()): i for i, n in enumerate(names)}
    marked = marks.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    numbers = F.create_map(*[F.lit(x) for pair in key.items() for x in pair])
    areas_of = F.transform(F.filter("keys", lambda k: k.isin(list(key))), lambda k: numbers[k]).alias("areas")
    marked = marked.filter(F.arrays_overlap("keys", F.array(*[F.lit(k) for k in [*key, "none"]]))).select("doc_id", areas_of)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    known = docs.join(marked, "doc_id").select("words", "sizes", "places", "lines", "first_out", "last_out", "areas", fold)
    known = materialize(known, "labelled")
    if known.isEmpty():
        return spark.createDataFrame([], schema)
    fitting = Fitting(known, len(names), languages)
    fitted = fitting.start()
    for heat in HEATS:
        fitted = fitting.round(fitted, heat)
    least, models = fitting.levels(fitted), fitted[2]
    shared = spark.sparkContext.broadcast((models.uni, models.bi, models.totals, languages, least))

    def run(batches):
        uni, bi, totals, words, least = shared.value
        models = Models(uni, bi, totals)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = hashed(opened(batch), words)
            doc, subject = np.nonzero(accepted(models.evidence(s), s.doc, batch.num_rows, least))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), pa.array([names[i] for i in subject], pa.string())], ["doc_id", "subject"])

    return docs.select("doc_id", "words", "sizes", "places", "lines", "first_out", "last_out").mapInArrow(run, schema)
