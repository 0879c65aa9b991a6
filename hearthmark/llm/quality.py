"""Operator 3: quality rules, line first.

Every line is judged: does it end like a sentence, does it look like
navigation, is it boilerplate?  Lines that fail are removed, and a document
that loses too much of its text this way is rejected.  All rules of a batch
are counts over its bytes, so nothing is shuffled and rows do not influence
each other.

A line is *unended* if its last character does not end a sentence and none of
``.``, ``!`` and ``?`` stands before a blank in it.  Of the lines with a word
these fail:

* punctuation: an unended line of ``unended_words`` or more;
* navigation: an unended line in a run of ``menu_run`` or more such lines, as in
  a menu of one entry a line; an unended line of ``title_words`` or more words
  most of which begin with a capital; a line with many separators; a short
  line that begins like a control of a page ("skip to content");
* boilerplate: a line with a phrase of legal or cookie notices;
* symbols, shouting, and a line equal to an earlier one of its text.

A heading between sentences stands alone and passes.

A null text counts as one without words.  A text without words fails the base
rules.  Rows repeat if their input rows repeat; other columns stay as they are.
Texts may have any length and are read whole; one text is one item of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearthmark.llm import textops

# Characters that count as symbols, that end a sentence, and that part navigation entries.
SYMBOLS = b"#*$%&|<>"
SENTENCE_ENDS = b".!?:;)\"'"
SENTENCE_ENDS_WIDE = ("…", "。", "！", "？", "”", "’", "»")
SEPARATORS = b"|>"
SEPARATORS_WIDE = ("·", "•", "›")
# Phrases of boilerplate lines, lower case.
PHRASES = tuple(
    phrase.encode()
    for phrase in (
        "all rights reserved",
        "cookie policy",
        "accept cookies",
        "accept all cookies",
        "use cookies",
        "uses cookies",
        "cookie settings",
        "enable javascript",
        "privacy policy",
        "terms of service",
        "terms of use",
        "terms and conditions",
        "lorem ipsum",
        "subscribe to our newsletter",
        "sign up for our newsletter",
        "click here",
        "powered by wordpress",
        "this site is protected by recaptcha",
        "unsubscribe at any time",
        "tous droits réservés",
        "politique de confidentialité",
        "mentions légales",
        "conditions générales d'utilisation",
        "utilise des cookies",
        "accepter les cookies",
        "alle rechte vorbehalten",
        "datenschutzerklärung",
        "allgemeine geschäftsbedingungen",
        "verwendet cookies",
        "cookies akzeptieren",
        "todos los derechos reservados",
        "política de privacidad",
        "política de cookies",
        "utiliza cookies",
        "aceptar cookies",
        "aviso legal",
    )
)
# How short lines of page controls begin, lower case.
CONTROLS = tuple(
    start.encode()
    for start in (
        "skip to content",
        "skip to main content",
        "back to top",
        "read more",
        "load more",
        "share this",
        "share on",
        "follow us",
        "log in",
        "sign in",
        "sign up",
        "add to cart",
        "leave a comment",
        "previous post",
        "next post",
        "retour en haut",
        "lire la suite",
        "nach oben",
        "weiterlesen",
        "volver arriba",
        "leer más",
    )
)


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are parts of one."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    #: an unended line fails if it has so many words at least
    unended_words: int = 12
    #: unended lines fail if so many follow each other, lines without a word left out
    menu_run: int = 4
    #: an unended line of so many words fails if more than this share of them begin with a capital
    title_words: int = 5
    max_title_share: float = 0.8
    #: a line of at most so many words fails if it begins like a page control
    control_words: int = 6
    max_separator_share: float = 0.15
    max_symbol_share: float = 0.1
    max_upper_share: float = 0.6
    upper_letters: int = 20
    max_lost_share: float = 0.5
    phrases: tuple[bytes, ...] = field(default=PHRASES)
    controls: tuple[bytes, ...] = field(default=CONTROLS)


def _is_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _SEPARATOR, _END = _is_in(SYMBOLS), _is_in(SEPARATORS), _is_in(SENTENCE_ENDS)


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive cuts."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[cuts])


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


class Measures:
    """Counts and line verdicts for the texts of one chunk."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, rules: Rules) -> None:
        self.body, self.offsets, self.rules, n = body, offsets, rules, len(offsets) - 1
        starts, ends, word_at = textops.word_spans(body, offsets)
        self.n_words = np.diff(word_at)
        word_row = np.repeat(np.arange(n), self.n_words)
        char = (body & 0xC0) != 0x80
        self.word_chars = np.bincount(word_row, _between(char, starts, ends), n).astype(np.int64)
        symbol = _SYMBOL[body]
        self.n_symbols = _sums(symbol, offsets)
        self._lines(symbol, char, starts)
        self._repeats(starts, ends, word_at, word_row)
        few = self.n_words < rules.min_words
        self.base_failed = few | (self.n_repeat_words > rules.max_repeat_share * self.n_words)
        lost = np.bincount(self.line_row, self.line_chars * self.line_failed, n)
        held = np.bincount(self.line_row, self.line_chars, n)
        self.kept = ~self.base_failed & (lost <= rules.max_lost_share * held)

    def _lines(self, symbol: np.ndarray, char: np.ndarray, word_starts: np.ndarray) -> None:
        """Line spans and which lines with a word fail a rule."""
        body, rules, n = self.body, self.rules, len(self.offsets) - 1
        breaks = np.flatnonzero(body == 10)
        row_of_break = np.searchsorted(self.offsets, breaks, side="right") - 1
        per_row = np.bincount(row_of_break, minlength=n) + 1 if n else np.zeros(0, np.int64)
        self.line_row = np.repeat(np.arange(n), per_row)
        first = np.cumsum(per_row) - per_row
        self.line_start, self.line_end = np.zeros(len(self.line_row), np.int64), np.zeros(len(self.line_row), np.int64)
        later = np.ones(len(self.line_row), bool)
        later[first] = False
        self.line_start[first], self.line_start[later] = self.offsets[:-1], breaks + 1
        last = np.zeros(len(self.line_row), bool)
        last[first + per_row - 1] = True
        self.line_end[last], self.line_end[~last] = self.offsets[1:], breaks
        s, e = self.line_start, self.line_end
        words = np.searchsorted(word_starts, e) - np.searchsorted(word_starts, s)
        self.line_chars = _between(char, s, e)
        # equal to an earlier line of the same text
        key = textops.mixed(textops.span_hashes(body, s, e) + self.line_row.astype(np.uint64) * np.uint64(textops.BASES[1]))
        _, example = np.unique(key, return_index=True)
        repeated = np.ones(len(key), bool)
        repeated[example] = False
        repeated &= words > 0
        self.n_dup_lines = np.bincount(self.line_row, repeated, n).astype(np.int64)
        # the last character that is not blank
        visible = np.flatnonzero(~textops._SPACE[body])
        at = np.searchsorted(visible, e) - 1
        final = visible[np.maximum(at, 0)] if len(visible) else np.zeros(len(e), np.int64)
        ended = _END[body[final]] if len(body) else np.zeros(len(e), bool)
        for mark in SENTENCE_ENDS_WIDE:
            tail = mark.encode()
            same = final + 1 >= len(tail)
            for k, b in enumerate(reversed(tail)):
                same &= body[np.maximum(final - k, 0)] == b if len(body) else False
            ended |= same
        upper = (body >= 65) & (body <= 90)
        letter = upper | ((body >= 97) & (body <= 122)) | ~char | (body >= 0xC0)
        letters = _between(letter & char, s, e)
        chars = np.maximum(self.line_chars, 1)
        mark = np.zeros(len(body), bool)
        if len(body):
            mark[:-1] = ((body == 46) | (body == 33) | (body == 63))[:-1] & textops._SPACE[body[1:]]
        unended = ~ended & (_between(mark, s, e) == 0) & (words > 0)
        failed = unended & (words >= rules.unended_words)
        failed |= self._menus(unended, words)
        capital = upper.copy()
        if len(body):  # Latin capitals beyond ASCII: two bytes, C3 80 to C3 9E
            capital[:-1] |= (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E)
        titled = np.zeros(len(body), bool)
        titled[word_starts] = capital[word_starts]
        failed |= unended & (words >= rules.title_words) & (_between(titled, s, e) > rules.max_title_share * words)
        failed |= self._separators(s, e) > rules.max_separator_share * np.maximum(words, 1)
        failed |= _between(symbol, s, e) > rules.max_symbol_share * chars
        failed |= (letters >= rules.upper_letters) & (_between(upper, s, e) > rules.max_upper_share * letters)
        failed |= repeated
        lowered = textops.lower_ascii(body).tobytes()
        for phrase in rules.phrases:
            for line, p in self._found(lowered, phrase):
                failed[line] |= p + len(phrase) <= e[line]
        if len(visible):
            opening = visible[np.minimum(np.searchsorted(visible, s), len(visible) - 1)]
            for start in rules.controls:
                for line, p in self._found(lowered, start):
                    failed[line] |= bool(p == opening[line] and words[line] <= rules.control_words)
        self.line_failed = failed & (words > 0)

    def _found(self, lowered: bytes, phrase: bytes) -> Iterator[tuple[int, int]]:
        """Line and place of every occurrence of a phrase."""
        p = lowered.find(phrase)
        while p >= 0:
            yield int(np.searchsorted(self.line_start, p, side="right")) - 1, p
            p = lowered.find(phrase, p + len(phrase))

    def _menus(self, unended: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Lines in long runs of unended lines of one text."""
        worded = np.flatnonzero(words > 0)
        loose, row = unended[worded], self.line_row[worded]
        fresh = np.ones(len(worded), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (loose[1:] != loose[:-1])
        run = np.cumsum(fresh) - 1
        long = np.bincount(run, minlength=1)[run] >= self.rules.menu_run if len(run) else np.zeros(0, bool)
        found = np.zeros(len(unended), bool)
        found[worded] = loose & long
        return found

    def _separators(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """How many separators of navigation entries each line holds."""
        body, at = self.body, _SEPARATOR[self.body]
        for mark in SEPARATORS_WIDE:
            tail = np.frombuffer(mark.encode(), np.uint8)
            if len(body) >= len(tail):
                whole = np.ones(len(body) - len(tail) + 1, bool)
                for k, b in enumerate(tail):
                    whole &= body[k : k + len(whole)] == b
                at[: len(whole)] |= whole
        return _between(at, s, e)

    def _repeats(self, starts: np.ndarray, ends: np.ndarray, word_at: np.ndarray, word_row: np.ndarray) -> None:
        """Words in 3-word windows that occur twice or more in their text."""
        n = len(self.offsets) - 1
        self.n_repeat_words = np.zeros(n, np.int64)
        if len(starts) < 3:
            return
        windows = textops.window_hashes(textops.span_hashes(self.body, starts, ends), 3)
        inside = np.flatnonzero(word_row[:-2] == word_row[2:])
        key = textops.mixed(windows[inside] + word_row[inside].astype(np.uint64) * np.uint64(textops.BASES[1]))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = inside[times[which] >= 2]
        covered = np.zeros(len(starts) + 3, np.int64)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 3, -1)
        self.n_repeat_words = np.bincount(word_row, np.cumsum(covered)[: len(starts)] > 0, n).astype(np.int64)

    def cleaned(self, row: int) -> str:
        """The text of a row without its failed lines."""
        a, b = np.searchsorted(self.line_row, [row, row + 1])
        good = [bytes(self.body[s:e]) for s, e, bad in zip(self.line_start[a:b], self.line_end[a:b], self.line_failed[a:b], strict=True) if not bad]
        return b"\n".join(good).decode()


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = T.StructType(
    [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def judge(df: DataFrame, text: str = "text", cleaned: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """Add the counts and verdicts of every row, and its cleaned text under the name ``cleaned`` if one is given.

    ``cleaned`` may be the text column itself.  A null text stays null there.
    Input columns that have the name of an added column are replaced.
    """
    kept = [c for c in df.columns if c not in {*ADDED.names, cleaned} - {text}]
    added = [*ADDED.fields, *([T.StructField(cleaned, T.StringType())] if cleaned else [])]
    schema = T.StructType([*[df.schema[c] for c in kept if c != cleaned], *added])
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textops.text_bytes(batch.column(place))
            for low, high in textops.chunks(offsets):
                found = Measures(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], rules)
                part = batch.slice(low, high - low)
                columns = [part.column(i) for i, c in enumerate(kept) if c != cleaned]
                columns += [pa.array(getattr(found, c), pa.int64()) for c in COUNTS]
                columns += [pa.array(found.base_failed, pa.bool_()), pa.array(found.kept, pa.bool_())]
                if cleaned:
                    there = part.column(place).is_valid().to_pylist()
                    columns.append(pa.array([found.cleaned(i) if there[i] else None for i in range(high - low)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)
