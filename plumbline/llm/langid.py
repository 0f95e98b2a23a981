"""Languages of documents and of passages in them, by rank-order profiles of n-grams.

A language's profile is its most frequent n-grams in order of frequency. A sentence's n-grams are ranked
the same way, and the language whose ranks differ least in sum (the out-of-place distance) is its
language. Profiles are fitted on a bounded sample of labelled documents, cleaned once by their own verdicts,
so that wrong labels do not stay in them. All sentences of a batch are scored in a few array operations.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship

#: Names by which labels name a language: codes of ISO 639, then own names and names in other languages (fixed values).
NAMES = {
    "en": ["en", "eng", "english", "englisch", "engels", "engelska", "anglais", "inglés", "inglês", "inglese", "angielski", "английский", "英語"],
    "de": ["de", "deu", "ger", "german", "deutsch", "duits", "tyska", "allemand", "alemán", "alemão", "tedesco", "niemiecki", "немецкий", "ドイツ語"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish", "vlaams", "niederländisch", "nederländska", "néerlandais", "neerlandés", "holandés", "holandês", "olandese", "niderlandzki", "нидерландский", "オランダ語"],
    "sv": ["sv", "swe", "swedish", "svenska", "schwedisch", "zweeds", "suédois", "sueco", "svedese", "szwedzki", "шведский", "スウェーデン語"],
    "fr": ["fr", "fra", "fre", "french", "français", "französisch", "frans", "franska", "francés", "francês", "francese", "francuski", "французский", "フランス語"],
    "es": ["es", "spa", "spanish", "español", "castellano", "castilian", "spanisch", "spaans", "spanska", "espagnol", "espanhol", "spagnolo", "hiszpański", "испанский", "スペイン語"],
    "pt": ["pt", "por", "portuguese", "português", "portugiesisch", "portugees", "portugisiska", "portugais", "portugués", "portoghese", "portugalski", "португальский", "ポルトガル語"],
    "it": ["it", "ita", "italian", "italiano", "italienisch", "italiaans", "italienska", "italien", "włoski", "итальянский", "イタリア語"],
    "pl": ["pl", "pol", "polish", "polski", "polnisch", "pools", "polska", "polonais", "polaco", "polonês", "polacco", "польский", "ポーランド語"],
    "ru": ["ru", "rus", "russian", "русский", "russisch", "ryska", "russe", "ruso", "russo", "rosyjski", "ロシア語"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語", "japanisch", "japans", "japanska", "japonais", "japonés", "japonês", "giapponese", "japoński", "японский"],
}
#: Words before a language's name in a label that say only that it is one (fixed values).
_PREFIX = frozenset("lang language locale code iso sprache taal språk langue idioma lingua język язык 言語".split())
LANGUAGES = list(NAMES)


def plain(text: str) -> str:
    """Lower case without accents, so that spellings with and without them, composed or not, are one."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c) or c in "\u3099\u309a")
    return unicodedata.normalize("NFC", bare)


_BY_NAME = {plain(name): code for code, names in NAMES.items() for name in names}
_PREFIX_WORDS = frozenset(map(plain, _PREFIX))

#: Bound of the fitting sample: labelled documents per language, and the length up to which one is taken.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 300, 4_000
#: n-grams kept per language.
PROFILE = 1_500
#: Relative lead over the second language below which a sentence takes its neighbours' language.
CLEAR = 0.04
_MULTIPLIER = np.uint64(0x100000001B3)

_FENCE = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*|\Z)", re.S | re.M)
_BLANKED = re.compile(r"`[^`\n]*`|</?[A-Za-z][^<>\n]{0,200}>|&(?:lt|gt|amp|quot|nbsp|#\d+);|\x1b\[[0-9;]*m|https?://\S+|[\u200b\u200c\u200d\u2060\ufeff]+")
_LINE = re.compile(r"[^\r\n  \x85\x0b\x0c]+")
_NO_PROSE_START, _NO_PROSE_END = tuple("#|{}"), tuple(";{}|")
_COMMENT = re.compile(r"^\s*//(?!/)")
_END = re.compile(r"[.!?…]+(?=[\s\"'”’»)\]]|$)|[。！？]+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_KANA = re.compile(r"[぀-ヿ一-鿿]")
_JAPANESE = re.compile(r"[぀-ヿ㐀-鿿]+")
_INNER = re.compile(r"[a-z][A-Z]|\w[._/\\(){}\[\]<>=:]\w|[\d_\\/{}<>=|]")
_MOJIBAKE = re.compile("[ÂÃÅÄÐÑãâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_LATIN = {c: bytes([b]) for b in range(256) for c in [bytes([b]).decode("cp1252", "ignore") or chr(b)]}


def label_languages(label: str | None) -> list[str]:
    """The two-letter codes of the languages that a label names, each by a code, a region tag or a name; sorted.

    Several names may be joined by commas, semicolons, slashes, bars, plus or ampersand signs. A name's first word counts
    (``de-DE``, ``English (US)``, ``lang=de``); a later one only if it is a name of four letters or more (``Brazilian Portuguese``).
    """
    found = set()
    for part in re.split(r"[,;/|+&]", plain(label or "")):
        words = [w for w in re.findall(r"[^\W\d_]+", part) if w not in _PREFIX_WORDS]
        code = _BY_NAME.get(words[0]) if words else None
        code = code or next((_BY_NAME[w] for w in words[1:] if len(w) >= 4 and w in _BY_NAME), None)
        if code:
            found.add(code)
    return sorted(found)


def label_language(label: str | None) -> str | None:
    """The one language that a label names, else None."""
    codes = label_languages(label)
    return codes[0] if len(codes) == 1 else None


def repair(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252, where that gives valid text."""
    if not _MOJIBAKE.search(text):
        return text
    try:
        return b"".join(_LATIN[c] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return re.sub("[\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2,}", lambda m: _piece(m[0]), text)


def _piece(text: str) -> str:
    try:
        return b"".join(_LATIN[c] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return text


#: Words and sentences remembered per worker; beyond that the memory starts afresh.
REMEMBERED = 300_000


class _Words(dict):
    """The words in each blank-separated token seen, found when it is first asked for."""

    def __missing__(self, raw: str) -> str:
        word = _word(raw)
        if len(raw) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[raw] = word
        return word


_words = _Words()


def _word(raw: str) -> str:
    """The lower-case words in one blank-separated token; none if it is an identifier or a number."""
    word = raw.strip(".,;:!?\"'()[]«»„“”‚‘’*…。、>")
    if not word:
        return ""
    if _INNER.search(word):
        return " ".join(_JAPANESE.findall(word)) if _KANA.search(word) else ""
    return " ".join(_LETTERS.findall(word)).lower()


def words_of(sentence: str) -> str:
    """Lower-case words of a sentence with single blanks around; identifiers and numbers are left out."""
    text = sentence if sentence.isascii() else unicodedata.normalize("NFC", repair(sentence)).replace("\u00ad", "")
    kept = " ".join(filter(None, map(_words.__getitem__, text.split())))
    return f" {kept} " if kept else ""


def _outside_code(text: str) -> str:
    """The text with code, tags and links blanked, at unchanged positions."""
    return _BLANKED.sub(_blank, _FENCE.sub(_blank, text) if "```" in text else text)


def _blank(found: re.Match[str]) -> str:
    return re.sub(r"[^\r\n]", " ", found[0])


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Full sentences of prose: start and end in ``text``, and the words that count.

    Code, tables, headings, tags, identifiers and fragments without an end mark are left out. A line comment
    is judged by its text, so that commented-out code is left out as code is.
    """
    shown = _outside_code(text)
    out = []
    for line in _LINE.finditer(shown):
        said = line[0].strip()
        if not said or said.startswith(_NO_PROSE_START) or said.endswith(_NO_PROSE_END):
            continue
        whole = _COMMENT.sub(_blank, line[0]) if said.startswith("//") else line[0]
        at = 0
        for end in _END.finditer(whole):
            part, first, at = whole[at : end.end()], at, end.end()
            if len(part) < 6:
                continue
            words = words_of(part)
            if words.count(" ") >= 4 or not words.isascii() and len(_KANA.findall(words)) >= 5:
                begin = line.start() + first + len(part) - len(part.lstrip())
                out.append((begin, line.start() + at, words))
    return out


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of 1 to 4 characters within words with their borders, and their text's number."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end, space = points == 10, points == 32
    owner = np.cumsum(end)
    codes, owners = [], []
    code, good, inner = points + np.uint64(1), ~end, np.ones(len(points), bool)
    for n in range(1, 5):
        size = len(points) - n + 1
        if size <= 0:
            break
        if n > 1:
            code = code[:size] * _MULTIPLIER + points[n - 1 :] + np.uint64(n)
            good = good[:size] & ~end[n - 1 :]
            if n > 2:
                inner = inner[:size] & ~space[n - 2 : n - 2 + size]
        take = good & inner[:size] if n > 1 else good & ~space
        codes.append(code[take])
        owners.append(owner[:size][take])
    return np.concatenate(codes), np.concatenate(owners)


@dataclass(frozen=True)
class Profiles:
    """Sorted n-gram codes, their rank in each language, and their rank over all languages."""

    codes: np.ndarray
    ranks: np.ndarray
    overall: np.ndarray

    @staticmethod
    def fit(samples: dict[str, list[str]], size: int = PROFILE) -> Profiles:
        """Profiles of the sentences (as ``words_of`` gives them) of each language."""
        tops, total = [], Counter()
        for code in LANGUAGES:
            grams, n = np.unique(gram_codes(samples.get(code) or [])[0], return_counts=True)
            order = np.lexsort((grams, -n))[:size]
            tops.append(grams[order])
            share = max(1, int(n.sum()))
            for g, c in zip(grams[order].tolist(), n[order].tolist(), strict=True):
                total[g] += c / share
        codes = np.array(sorted(total), np.uint64)
        ranks = np.full((len(codes), len(LANGUAGES)), size, np.int32)
        for k, top in enumerate(tops):
            ranks[np.searchsorted(codes, top), k] = np.arange(len(top))
        weight = np.array([total[int(c)] for c in codes])
        overall = np.empty(len(codes), np.int32)
        overall[np.argsort(-weight, kind="stable")] = np.arange(len(codes))
        return Profiles(codes, ranks, overall)

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean out-of-place distance of each text to each language; rows of zeros where nothing is known."""
        out = np.zeros((len(texts), len(LANGUAGES)))
        grams, owner = gram_codes(texts)
        if not len(grams) or not len(self.codes):
            return out
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        known = self.codes[at] == grams
        key, n = np.unique(owner[known] * len(self.codes) + at[known], return_counts=True)
        if not len(key):
            return out
        text, gram = np.divmod(key, len(self.codes))
        order = np.argsort((text * (n.max() + 1) - n) * len(self.codes) + self.overall[gram])  # by text, count, and rank over all languages
        text, gram = text[order], gram[order]
        firsts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        sizes = np.diff(np.append(firsts, len(text)))
        rank = np.arange(len(text)) - np.repeat(firsts, sizes)
        apart = np.abs(self.ranks[gram] - rank[:, None])
        out[text[firsts]] = np.add.reduceat(apart, firsts, axis=0) / sizes[:, None]
        return out

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest language, -1 where nothing is known, and the relative lead over the next."""
        d = self.distances(texts)
        best = d.argmin(axis=1)
        two = np.partition(d, 1, axis=1)[:, :2]
        lead = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
        best[d.sum(axis=1) == 0] = -1
        return best, lead


def fit_profiles(labelled: list[tuple[str, str]], size: int = PROFILE) -> Profiles:
    """Profiles of (language, text) pairs, fitted, cleaned by their own verdicts, and fitted again."""
    samples: dict[str, list[str]] = {}
    for code, text in labelled:
        samples.setdefault(code, []).extend(w for _, _, w in sentences(text))
    profiles = Profiles.fit(samples, size)
    for _ in range(2):
        clean = {}
        for code, texts in samples.items():
            best, lead = profiles.classify(texts)
            clean[code] = [t for t, b, x in zip(texts, best.tolist(), lead.tolist(), strict=True) if b == LANGUAGES.index(code) and x > CLEAR]
        if any(clean.values()):
            profiles = Profiles.fit({c: clean.get(c) or samples[c] for c in samples}, size)
    return profiles


def labelled_sample(documents: DataFrame, per_language: int = SAMPLE_DOCUMENTS, most_chars: int = SAMPLE_CHARS, text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, the first by a hash of the text.

    The bound holds at any size of the corpus; only its few texts come to the driver.
    """
    head = F.split(F.lower(F.trim(F.col(lang))), r"[-_\s(,;/]")[0]
    names = {spelling: code for code, given in NAMES.items() for name in given for spelling in (name, plain(name))}
    pairs = F.create_map(*[F.lit(x) for name, code in names.items() for x in (name, code)])
    code = F.element_at(pairs, F.when(head.isin(list(names)), head))
    rows = documents.where(F.length(text).between(20, most_chars)).select(code.alias("code"), F.col(text).alias("text")).where("code is not null")
    n = F.xxhash64("text")
    best = rows.groupBy("code", F.pmod(n, F.lit(per_language)).alias("slot")).agg(F.min_by("text", n).alias("text"))
    return [(r["code"], r["text"]) for r in best.orderBy("code", "slot").collect()]


SEGMENT = "doc_id bigint, lang_named string, segment int, begin int, stop int, lang string, confidence double, sentences int"


def segments_of(found: list[tuple[int, int, str]], best: np.ndarray, lead: np.ndarray, clear: float = CLEAR) -> list[tuple[int, int, str, float, int]]:
    """Passages of one document: runs of sentences of one language, with their mean lead.

    A sentence whose lead is small, or of which nothing is known, takes the language of the clear sentence
    before it, else of the one after; a document without any clear sentence keeps the nearest one.
    """
    names = [LANGUAGES[b] if b >= 0 else None for b in best.tolist()]
    sure = [n if x >= clear else None for n, x in zip(names, lead.tolist(), strict=True)]
    if any(sure):
        last = None
        for i, n in enumerate(sure):
            last = n or last
            sure[i] = last
        first = next(n for n in sure if n)
        sure = [n or first for n in sure]
    else:
        votes = Counter(n for n in names if n)
        if not votes:
            return []
        sure = [votes.most_common(1)[0][0]] * len(names)
    out: list[list] = []
    for (begin, stop, _), lang, x in zip(found, sure, lead.tolist(), strict=True):
        if out and out[-1][2] == lang:
            out[-1][1], out[-1][4] = stop, out[-1][4] + 1
            out[-1][3] += x
        else:
            out.append([begin, stop, lang, x, 1])
    return [(b, s, lang, round(min(1.0, x / n), 6), n) for b, s, lang, x, n in out]


def classify_known(profiles: Profiles, texts: list[str], known: dict[str, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """``Profiles.classify``, each distinct text once; ``known`` keeps verdicts between calls."""
    if len(known) > REMEMBERED:
        known.clear()
    new = [t for t in dict.fromkeys(texts) if t not in known]
    for at in range(0, len(new), 4_000):
        part = new[at : at + 4_000]
        best, lead = profiles.classify(part)
        known.update(zip(part, zip(best.tolist(), lead.tolist(), strict=True), strict=True))
    got = [known[t] for t in texts]
    return np.array([b for b, _ in got]), np.array([x for _, x in got])


#: Language of a text of which nothing is known.
UNKNOWN = "und"


def nearest_language(text: str | None, profiles: Profiles) -> str:
    """The nearest language of all words outside code, ``und`` where none is known."""
    words = words_of(_outside_code(text)) if text else ""
    best = profiles.classify([words])[0][0] if words else -1
    return LANGUAGES[best] if best >= 0 else UNKNOWN


def detect_batch(batch: pa.RecordBatch, profiles: Profiles, known: dict[str, tuple[int, float]] | None = None, every: bool = False) -> pa.RecordBatch | None:
    """Segment rows of one batch of (doc_id, text, lang); with ``every``, a row without sentences for each other text."""
    held, flat = [], []
    for text in batch.column(1).to_pylist():
        got = sentences(text) if text else []
        held.append((len(flat), got))
        flat.extend(w for _, _, w in got)
    if not flat and not every:
        return None
    best, lead = classify_known(profiles, flat, {} if known is None else known)
    rows = []
    for at_row, (doc, label, (at, got)) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), held, strict=True)):
        named = ",".join(label_languages(label)) or None
        span = slice(at, at + len(got))
        own = segments_of(got, best[span], lead[span]) if got else []
        if every and not own:
            text = batch.column(1)[at_row].as_py()
            own = [(0, len(text or ""), nearest_language(text, profiles), 0.0, 0)]
        rows.extend((doc, named, i, *x) for i, x in enumerate(own))
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names) if rows else None


def _detecting(profiles: Profiles, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = detect_batch(batch.slice(at, 512), profiles, known, every)
                if out is not None:
                    yield out

    return run


def language_segments(documents: DataFrame, profiles: Profiles | None = None, every: bool = False) -> DataFrame:
    """Passages in one language: ``doc_id, lang_named, segment, begin, stop, lang, confidence, sentences``.

    ``begin`` and ``stop`` are character positions in the text, ``lang_named`` is the language its label
    names (null for none, several joined by commas). Null, empty and blank texts and texts without a full sentence give no rows, or
    with ``every`` one of no sentences and no confidence, in the language nearest to their words, else ``und``.
    One pass over whole texts, without a shuffle.
    """
    ship(documents.sparkSession)
    profiles = profiles or fit_profiles(labelled_sample(documents))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").mapInArrow(_detecting(profiles, every), SEGMENT)


def document_languages(segments: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence, share``: the language of most sentences, ties by code; 0 where there is none."""
    per = segments.groupBy("doc_id", "lang").agg(F.sum("sentences").alias("n"), F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.col("sentences")), F.sum("sentences")), F.lit(0.0)).alias("confidence"))
    best = per.groupBy("doc_id").agg(F.min_by(F.struct("lang", "confidence"), F.struct(-F.col("n"), F.col("lang"))).alias("b"), F.sum("n").alias("all"), F.max("n").alias("most"))
    return best.select("doc_id", "b.lang", F.round("b.confidence", 6).alias("confidence"), F.coalesce(F.try_divide("most", "all"), F.lit(0.0)).alias("share"))


def unnamed_languages(segments: DataFrame) -> DataFrame:
    """``doc_id, lang``: languages with a full sentence in the text that its label does not name."""
    named = F.array_contains(F.split(F.coalesce("lang_named", F.lit("")), ","), F.col("lang"))
    return segments.where(~named).select("doc_id", "lang").distinct()
