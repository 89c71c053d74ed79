"""Text quality figures for each document, and the structural profile its lines come nearest to.

Every line becomes a distribution over classes: function words of five kinds (of the language whose function
words the line and its neighbours have most of), other words, capitals, digits, stops, column gaps,
signs, unpronounceable words, and how the line opens and closes. Prose has profiles of its own in each
language, lists, tables and junk have shared ones. Profiles start from rough built-in ones and are fitted on
labelled pages; a line is what the profile with the least Jensen-Shannon divergence is, and a document is
what most of its lines are. Each text is judged alone, in array operations over Arrow batches, without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words by kind (articles and the like, prepositions, possessives, auxiliaries, links).
# Two-letter words that begin with a vowel are left out, as chance makes them too.
FUNCTION_WORDS = {
    "en": (
        ("the", "this", "that", "these", "one", "every", "each"),
        ("of", "by", "to", "for", "from", "with", "upon", "under", "near", "after", "before"),
        ("his", "her", "their", "our", "its"),
        ("was", "were", "been", "be", "has", "had", "have", "are", "will", "would", "should", "could", "may", "must", "can"),
        ("and", "but", "until", "though", "while", "because", "when", "not"),
    ),
    "de": (
        ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "einen", "einem", "dieser", "diese", "jede"),
        ("von", "vor", "bei", "zu", "aus", "mit", "nach", "auf", "unter", "über", "für", "durch"),
        ("ihr", "sein", "unser"),
        ("wurde", "wird", "war", "ist", "hat", "hatte", "kann", "soll", "muss"),
        ("und", "oder", "aber", "denn", "weil", "als", "nicht", "schon"),
    ),
    "fr": (
        ("le", "la", "les", "une", "des", "du", "cette", "ce", "chaque"),
        ("de", "dans", "par", "pour", "sur", "sous", "avec", "chez", "vers"),
        ("son", "sa", "ses", "leur", "notre"),
        ("est", "sont", "était", "fut", "sera", "peut", "doit", "avait", "ont"),
        ("mais", "lorsque", "tandis", "car", "parce", "que", "qui", "encore", "déjà"),
    ),
}
LANGUAGES = tuple(FUNCTION_WORDS)
WORD_KINDS = ("article", "preposition", "possessive", "auxiliary", "link")
CLASSES = (*WORD_KINDS, "word", "capital", "digit", "stop", "gap", "sign", "odd", "mark", "again", "closed")
#: How function words are spread over WORD_KINDS in the built-in profiles.
SPREAD = (0.3, 0.25, 0.1, 0.2, 0.15)
# Rough built-in profiles over function words as a whole and the classes after them.
ROUGH = {
    "prose": (
        (0.32, 0.57, 0.05, 0.01, 0.03, 0.005, 0.005, 0.01, 0.0, 0.0, 0.0),  # plain
        (0.15, 0.72, 0.07, 0.01, 0.03, 0.005, 0.005, 0.01, 0.0, 0.0, 0.0),  # few function words
        (0.16, 0.54, 0.07, 0.10, 0.09, 0.005, 0.005, 0.03, 0.0, 0.0, 0.0),  # with figures
        (0.25, 0.05, 0.64, 0.01, 0.03, 0.005, 0.005, 0.01, 0.0, 0.0, 0.0),  # headings
        (0.25, 0.57, 0.05, 0.01, 0.04, 0.005, 0.005, 0.01, 0.0, 0.01, 0.06),  # ends
    ),
    "list": (
        (0.13, 0.42, 0.05, 0.04, 0.05, 0.0, 0.0, 0.01, 0.25, 0.0, 0.05),  # marked items
        (0.0, 0.72, 0.11, 0.0, 0.11, 0.0, 0.0, 0.0, 0.0, 0.06, 0.0),  # names
        (0.03, 0.35, 0.05, 0.12, 0.14, 0.20, 0.0, 0.05, 0.0, 0.02, 0.04),  # prices
    ),
    "table": (
        (0.0, 0.32, 0.05, 0.28, 0.12, 0.23, 0.0, 0.0, 0.0, 0.0, 0.0),  # dot leaders
        (0.0, 0.28, 0.05, 0.34, 0.0, 0.33, 0.0, 0.0, 0.0, 0.0, 0.0),  # columns of numbers
        (0.0, 0.05, 0.0, 0.62, 0.06, 0.22, 0.02, 0.03, 0.0, 0.0, 0.0),  # measures and fractions
        (0.0, 0.45, 0.10, 0.0, 0.10, 0.35, 0.0, 0.0, 0.0, 0.0, 0.0),  # columns of words
    ),
    "junk": (
        (0.0, 0.08, 0.0, 0.04, 0.14, 0.04, 0.70, 0.0, 0.0, 0.0, 0.0),  # signs
        (0.0, 0.12, 0.05, 0.02, 0.0, 0.0, 0.0, 0.80, 0.0, 0.01, 0.0),  # single letters and consonants
        (0.02, 0.90, 0.02, 0.0, 0.04, 0.0, 0.0, 0.02, 0.0, 0.0, 0.0),  # words of no language
    ),
}
KINDS = tuple(ROUGH)
STOPS = ",.;:!?\"'’“”()"
DASHES = "-‐‑¬="
RULES = "-‐¬=.:|~*"
ENDS = ".!?:;”\"’'"
CONSONANTS = "bcdfghjklmnpqrstvwxzßç"
#: Weights, in characters, of a mark at the start of a line, of an opening that comes again nearby, and of a
#: line that opens like a sentence or item and closes with a stop.
MARK_WEIGHT, AGAIN_WEIGHT, CLOSED_WEIGHT = 12, 6, 4
#: Lines on either side in which an opening that comes again counts.
REACH = 3
#: Characters that are worked on at once. Longer texts are cut at line ends, with REACH lines of overlap that don't count.
CHUNK = 400_000
#: Labelled pages that profiles are fitted on, at most, and the lines that the built-in profiles weigh as.
SAMPLE_PAGES, PRIOR_LINES, FIT_ROUNDS = 500, 100, 5
#: Labelled pages with longer texts aren't fitted on, so the sample has a bound in bytes too.
SAMPLE_CHARS = 50_000
TOLD = ("lines", "words", "ink", "letters", "signs", "stops", *LANGUAGES, *(f"{k}_lines" for k in KINDS))
_LIMIT = 0x3000  # characters from here on count as letters
LETTER, UPPER, DIGIT, STOP, ODD, RULE, SIGNED, SPACE, HARSH, END, FIGURE = (1 << i for i in range(11))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its classes as bits, and the code it is read as (lower case, the long s and
    the digits 0 and 1 as the letters they stand for)."""
    bits, plain = np.zeros(_LIMIT + 1, np.uint16), np.arange(_LIMIT + 1, dtype=np.uint64)
    bits[_LIMIT] = LETTER
    for c in range(_LIMIT):
        ch, kind = chr(c), unicodedata.category(chr(c))
        letter, number, space = kind[0] == "L", kind[0] == "N", ch.isspace()
        odd = not (letter or number or space or ch == "_" or ch in STOPS or ch in DASHES)
        flags = (letter, kind == "Lu", "0" <= ch <= "9", ch in STOPS, odd, ch in RULES, letter or number or ch == "_", space, ch.lower() in CONSONANTS, ch in ENDS, "0" <= ch <= "9" or ch in "lIoO")
        bits[c] = sum(1 << i for i, f in enumerate(flags) if f)
        low = ch.lower()
        plain[c] = ord(low) if len(low) == 1 else c
    for ch, as_ in zip("ſ01", "sol", strict=True):
        plain[ord(ch)] = ord(as_)
        bits[ord(ch)] |= HARSH * (as_ in CONSONANTS)
    return bits, plain


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = _BASE, _INVERSE
    return np.cumprod(up), np.cumprod(down)


@cache
def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words and, for each and each language, the place of its kind (-1: none)."""
    plain, table = _tables()[1], {}
    for i, kinds in enumerate(FUNCTION_WORDS.values()):
        for j, words in enumerate(kinds):
            for word in words:
                code = plain[[ord(c) for c in word]]
                with np.errstate(over="ignore"):
                    h = int((code * _powers(32)[0][: len(code)]).sum(dtype=np.uint64))
                table.setdefault(h, [-1] * len(LANGUAGES))[i] = j
    keys = sorted(table)
    return np.array(keys, np.uint64), np.array([table[k] for k in keys], np.int64)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of a mask."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lines_of(pieces: list[str]) -> dict[str, np.ndarray]:
    """The lines of the texts that aren't blank: `rows` (counts over CLASSES), `language` (place in LANGUAGES),
    `owner` (place of the text), `start` (where in the text the line begins) and the figures summed up by `judge`."""
    joined = "\n".join(pieces) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bits_of, plain_of = _tables()
    code = np.minimum(code, _LIMIT)
    bits, n = bits_of[code], len(code)
    flag = lambda mask: (bits & mask) != 0
    newline = code == 10
    ends = np.flatnonzero(newline)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line_at = np.cumsum(newline) - newline
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    owner = np.searchsorted(begins[1:], starts, side="right")
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    at = lambda places, weight: np.bincount(line_at[places], weight, len(ends)).astype(float)
    after_ = lambda places, by: code[np.minimum(places + by, n - 1)]

    space = flag(SPACE)
    ink = ~space
    letters, capital, digit, stop, plain_sign, rule, filled = (count(m) for m in (flag(LETTER), flag(UPPER), flag(DIGIT), flag(STOP), flag(ODD), flag(RULE), ink))

    # Column gaps: inner runs of spaces, bars, dot leaders close or spaced, fractions.
    blank, bar, dot = code == 32, code == 124, code == 46
    before, after = np.concatenate([[10], code[:-1]]), np.concatenate([code[1:], [10]])
    s, e = _runs(blank)
    inner = (e - s >= 2) & (before[s] != 10) & (code[np.minimum(e, n - 1)] != 10)
    gap = at(s[inner], (e - s)[inner])
    p = np.flatnonzero(bar)
    gap += at(p, 1.0 + (before[p] == 32) + (after[p] == 32))
    s, e = _runs(dot)
    long = e - s >= 3
    gap += at(s[long], (e - s)[long])
    spaced = np.flatnonzero(dot & (before == 32))
    if len(spaced) > 1:
        close = np.diff(spaced) == 2
        chain = np.concatenate([close, [False]]) | np.concatenate([[False], close])
        gap += at(spaced[chain], np.full(chain.sum(), 2.0))
    p = np.flatnonzero((code == 47) & (before >= 48) & (before <= 57) & (after >= 48) & (after <= 57))
    gap += at(p, np.full(len(p), 3.0))

    # Words: function words by hash, and words that can't be spoken.
    s, e = _runs(flag(SIGNED))
    size, plain = e - s, plain_of[code]
    up, down = _powers(-(-n // (2 * CHUNK)) * 2 * CHUNK)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plain * up[:n])])
        hashed = (total[e] - total[s]) * down[s]
    keys, spoken = _function_hashes()
    place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    known = np.flatnonzero(keys[place] == hashed)
    function = np.zeros((len(LANGUAGES), len(WORD_KINDS), len(ends)))
    for i in range(len(LANGUAGES)):
        kind = spoken[place[known], i]
        has = kind >= 0
        function[i] = np.bincount(kind[has] * len(ends) + line_at[s[known[has]]], size[known[has]], len(WORD_KINDS) * len(ends)).reshape(len(WORD_KINDS), -1)
    harsh = flag(HARSH)
    hard = np.concatenate([[0], np.cumsum(harsh)])
    five = hard[5:] - hard[:-5] == 5 if n >= 5 else np.zeros(0, bool)
    fives = np.concatenate([[0], np.cumsum(five), np.full(5, five.sum())])
    next_ = code[np.minimum(e, n - 1)]
    odd_word = ((size == 1) & ((next_ == 32) | (next_ == 10))) | ((size >= 2) & (hard[e] - hard[s] == size)) | ((size >= 5) & (fives[np.maximum(e - 4, s)] > fives[s]))
    odd = np.where(letters > 0, at(s[odd_word], size[odd_word]), 0)
    words = count(ink & (space[np.concatenate([[0], np.arange(n - 1)])] | (np.arange(n) == 0)))

    # The first and last sign of each line that isn't blank, and its first token.
    full = np.flatnonzero(filled > 0)
    ink_places, inked = np.flatnonzero(ink), np.concatenate([[0], np.cumsum(ink)])
    first, last = ink_places[inked[starts[full]]], ink_places[inked[ends[full]] - 1]
    stops = flag(END)[last]
    own, letters_ = owner[full], letters[full]
    token = np.minimum(np.searchsorted(s, first), max(len(s) - 1, 0))
    worded = (s[token] == first) if len(s) else np.zeros(len(first), bool)
    token_end = np.where(worded, e[token], first + 1) if len(s) else first + 1
    token_size = token_end - first
    figured = np.concatenate([[0], np.cumsum(flag(FIGURE))])
    numbered = worded & (token_size <= 3) & (figured[token_end] - figured[first] == token_size)
    numbered &= ((after_(token_end, 0) == 46) | (after_(token_end, 0) == 41)) & (after_(token_end, 1) == 32)
    signed = ((bits[first] & (LETTER | DIGIT | SIGNED | STOP)) == 0) & ((after_(first, 1) == 32) | ((bits[np.minimum(first + 1, n - 1)] & LETTER) != 0))
    colon = np.flatnonzero((code == 58) & ((np.concatenate([[0], bits[:-1]]) & FIGURE) != 0))
    colon = colon[colon - starts[line_at[colon]] <= 10]
    labelled = (np.bincount(line_at[colon], minlength=len(ends)) > 0)[full]
    mark = (numbered | signed | labelled) & (letters_ > 0)

    def beside(x: np.ndarray, by: int, empty) -> np.ndarray:
        """x of the line `by` further on in the same text."""
        out = np.full(x.shape, empty, x.dtype)
        if 0 < abs(by) < len(x):
            here, there = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
            out[here] = np.where(own[here] == own[there], x[there], empty)
        return out

    near = lambda x: x + beside(x, 1, 0) + beside(x, -1, 0)
    # A line that opens and closes like an item counts as marked between marked ones.
    opens = (bits[first] & (UPPER | FIGURE)) != 0
    marked = lambda by: beside(mark, by, False) | (beside(mark, 2 * by, False) & opens & stops)
    mark = mark | (marked(1) & marked(-1))
    opening = np.where(worded & (token_size > 1), hashed[token] if len(s) else 0, 0).astype(np.uint64)
    again = np.zeros(len(full), bool)
    for by in (*range(-REACH, 0), *range(1, REACH + 1)):
        again |= (opening != 0) & (beside(opening, by, 0) == opening)
    opens = opens | mark
    closed = opens & stops & ((beside(opens, 1, False)) | (beside(own, 1, -1) == -1))

    function = function[:, :, full]
    mass = np.array([near(f) for f in function.sum(axis=1)])
    language = np.argmax(mass, axis=0)
    each = np.arange(len(full))
    # The words of a line are spread as those of the line and its neighbours are.
    kinds = np.array([near(function[language, j, each]) for j in range(len(WORD_KINDS))])
    share = kinds / np.maximum(near(letters_), 1)
    length, digit_ = filled[full] + words[full] - 1, digit[full]
    bare = (letters_ * 2 < length) & (digit_ * 3 < length)
    rows = np.column_stack(
        [
            *(letters_ * share),
            np.maximum(0, letters_ * (1 - share.sum(axis=0)) - capital[full] - odd[full]),
            capital[full],
            digit_,
            stop[full],
            gap[full],
            plain_sign[full] + np.where(bare, rule[full], 0),
            odd[full],
            mark * MARK_WEIGHT,
            again * AGAIN_WEIGHT,
            closed * CLOSED_WEIGHT,
        ]
    ).astype(float)
    told = np.column_stack([np.ones(len(full)), words[full], filled[full], letters_, plain_sign[full], stops, *function.sum(axis=1)])
    return {"rows": rows, "language": language, "owner": own, "start": starts[full] - begins[own], "told": told}


Profiles = dict[str, dict[str, np.ndarray]]


@cache
def rough_profiles() -> Profiles:
    """The built-in profiles over CLASSES by language and kind, before they are fitted."""
    spread = np.array(SPREAD)
    told = {k: np.array([np.concatenate([p[0] * spread, p[1:]]) / sum(p) for p in profiles]) for k, profiles in ROUGH.items()}
    return {language: told for language in LANGUAGES}


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(np.maximum(p, 1e-300))).sum(axis=-1)


def _divergences(shares: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences of rows from profiles, less the entropy of the row, which all have alike."""
    return np.column_stack([_entropy((shares + q) / 2) - _entropy(q) / 2 for q in profiles])


def nearest(rows: np.ndarray, language: np.ndarray, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """The place in KINDS, and the place among its kind, of the profile of the row's language with the
    least Jensen-Shannon divergence from each row of class counts; a row without counts is junk. Ties go to the earlier one."""
    weight = rows.sum(axis=1, keepdims=True)
    shares = rows / np.maximum(weight, 1e-300)
    kind, which = np.full(len(rows), KINDS.index("junk")), np.zeros(len(rows), np.int64)
    for i, name in enumerate(LANGUAGES):
        mine = np.flatnonzero((language == i) & (weight[:, 0] > 0))
        if len(mine):
            far = [_divergences(shares[mine], profiles[name][k]) for k in KINDS]
            kind[mine] = np.argmin(np.column_stack([f.min(axis=1) for f in far]), axis=1)
            which[mine] = np.array([f.argmin(axis=1) for f in far])[kind[mine], np.arange(len(mine))]
    return kind, which


def fit_profiles(texts: list[str], kinds: list[str], rounds: int = FIT_ROUNDS) -> Profiles:
    """The profiles after `rounds` of fitting to pages with a kind given by hand, of which some may be wrong.

    In each round the lines of the pages go to their nearest profiles, on a page of lists, tables or junk only to
    profiles of prose and of that kind, and a profile becomes the mean of its lines and of the built-in one,
    which counts as PRIOR_LINES lines. Prose profiles are fitted in each language, the others on all lines. Other kinds
    than KINDS and pages without lines don't count; without pages the built-in profiles remain.
    """
    start = rough_profiles()
    known = [(t, KINDS.index(k)) for t, k in zip(texts, kinds, strict=True) if t is not None and k in KINDS]
    if not known:
        return start
    parts = [lines_of([t for t, _ in known[i : i + 200]]) for i in range(0, len(known), 200)]
    rows, language = np.vstack([p["rows"] for p in parts]), np.concatenate([p["language"] for p in parts])
    label = np.array([k for _, k in known])[np.concatenate([p["owner"] + 200 * i for i, p in enumerate(parts)])]
    weight = rows.sum(axis=1)
    rows, language, label = rows[weight > 0], language[weight > 0], label[weight > 0]
    shares = rows / rows.sum(axis=1, keepdims=True)
    now = start
    for _ in range(rounds):
        kind, which = nearest(rows, language, now)
        fits = (kind == label) | (kind == 0)
        fitted: Profiles = {}
        for i, name in enumerate(LANGUAGES):
            fitted[name] = {}
            for k, told in enumerate(KINDS):
                mine = fits & (kind == k) & ((language == i) | (k > 0))
                means = [(PRIOR_LINES * p + shares[mine & (which == j)].sum(axis=0)) / (PRIOR_LINES + (mine & (which == j)).sum()) for j, p in enumerate(start[name][told])]
                fitted[name][told] = np.array(means)
        now = fitted
    return now


def judge(pieces: list[str], profiles: Profiles | None = None, spans: list[tuple[int, int]] | None = None) -> np.ndarray:
    """A row of the figures TOLD for each text, or for the lines that begin in its span."""
    line = lines_of(pieces)
    kind, _ = nearest(line["rows"], line["language"], profiles or rough_profiles())
    told = np.column_stack([line["told"], *(kind == i for i in range(len(KINDS)))])
    if spans is not None:
        low, high = np.array(spans).T
        told = told * ((line["start"] >= low[line["owner"]]) & (line["start"] < high[line["owner"]]))[:, None]
    return np.column_stack([np.bincount(line["owner"], x, len(pieces)) for x in told.T]).astype(np.int64)


def _reach_back(text: str, start: int) -> int:
    """Where the line begins that lies REACH lines with ink before the line that begins at `start`."""
    left = REACH
    while start > 0 and left:
        line = text.rfind("\n", 0, start - 1) + 1
        left -= bool(text[line:start].strip())
        start = line
    return start


def _reach_on(text: str, end: int) -> int:
    """Where the line ends that lies REACH lines with ink after the line that ends at `end`."""
    left = REACH
    while end < len(text) and left:
        line = text.find("\n", end + 1) if end + 1 <= len(text) else -1
        line = len(text) if line < 0 else line
        left -= bool(text[end + 1 : line].strip())
        end = line
    return end


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[tuple[int, int]]]]:
    """The texts in groups of about CHUNK characters, with their positions and the spans of them that count. A longer
    text is cut at line ends; its pieces reach REACH lines that aren't blank beyond their spans."""
    where, group, spans, held = [], [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at <= len(text):
            stop = len(text)
            if stop - at > CHUNK:
                cut_ = text.rfind("\n", at, at + CHUNK)
                cut_ = text.find("\n", at + CHUNK) if cut_ <= at else cut_
                stop = cut_ if cut_ > at else stop
            low, high = _reach_back(text, at), _reach_on(text, stop)
            where.append(i)
            group.append(text[low:high])
            spans.append((at - low, stop + 1 - low))
            held += high - low
            at = stop + 1
            if held >= CHUNK:
                yield where, group, spans
                where, group, spans, held = [], [], [], 0
    if group:
        yield where, group, spans


def labelled_sample(docs: DataFrame, labels: DataFrame, pages: int = SAMPLE_PAGES, id_col: str = "doc_id", text_col: str = "text", kind_col: str = "page_kind") -> tuple[list[str], list[str]]:
    """Texts and kinds of at most `pages` labelled pages, those with the smallest ids, so that a table in
    the order of its ids is read in part only. Ids and kinds come first; only chosen texts of at most SAMPLE_CHARS
    characters are read to the driver."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(kind_col).isin(*KINDS)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(kind_col).alias("kind")).distinct()
    chosen = {r[0]: r[1] for r in known.orderBy("doc_id", "kind").limit(pages).collect()}
    if not chosen:
        return [], []
    text = docs.where((F.length(text_col) <= SAMPLE_CHARS) & F.col(id_col).between(min(chosen), max(chosen)) & F.col(id_col).isin(*chosen))
    told = text.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).distinct().orderBy("doc_id", "text").collect()
    return [r[1] for r in told], [chosen[r[0]] for r in told]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", profiles: Profiles | None = None) -> DataFrame:
    """Figures of each text: doc_id, lines, words, mean_word_length, symbol_ratio (signs among
    characters), ends_in_stop (share of lines), common_words (share of letters in function words),
    language (with most function words; null without any), the lines of each kind, other_share
    (lines that aren't prose) and kind (prose, unless more than half the lines aren't: then the
    most frequent other kind, first of list, table, junk on ties).

    `profiles` are from `fit_profiles`, the built-in ones by default. Lines that are blank don't count. Whole
    texts are used. Null texts and null ids give no row; texts without a line have 0 lines and a null kind. Rows
    that repeat exactly give one row; one id with two texts gives two.
    """
    profiles = profiles or rough_profiles()

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), len(TOLD)), np.int64)
            for where, group, spans in _pieces(batch["text"].tolist()):
                np.add.at(out, where, judge(group, profiles, spans))
            yield pd.DataFrame(out, columns=list(TOLD)).assign(doc_id=batch["doc_id"].to_numpy())

    row = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{c} long" for c in (*TOLD, "doc_id"))
    told = row.mapInPandas(judged, schema)
    common = F.greatest(*LANGUAGES)
    language = F.when(F.col("en") == common, "en").when(F.col("de") == common, "de").otherwise("fr")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b)), F.lit(0.0))
    lines, prose = F.col("lines"), F.col("prose_lines")
    rest = F.greatest("list_lines", "table_lines", "junk_lines")
    other = F.when(F.col("list_lines") == rest, "list").when(F.col("table_lines") == rest, "table").otherwise("junk")
    return told.select(
        "doc_id",
        "lines",
        "words",
        share("ink", "words").alias("mean_word_length"),
        share("signs", "ink").alias("symbol_ratio"),
        share("stops", "lines").alias("ends_in_stop"),
        share(common, "letters").alias("common_words"),
        F.when(common > 0, language).alias("language"),
        *(f"{k}_lines" for k in KINDS),
        share(lines - prose, "lines").alias("other_share"),
        F.when(lines > 0, F.when((lines - prose) * 2 > lines, other).otherwise("prose")).alias("kind"),
    ).distinct()
