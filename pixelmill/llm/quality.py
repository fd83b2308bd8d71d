"""Quality rules: line-first cleaning.

Rules are evaluated for each line; failing lines go; a document that loses too much of its text is rejected.
The statistics over the whole text (word characters, symbols, repeated lines and word windows) are those that
corpus reports use, and two of them reject a document whatever its lines look like.

Defined results: a null text counts as empty; an empty text has no words and fails the base rule; a very long text is
judged whole; rows without an id are judged like any other; a line without a word is kept and weighs nothing; of equal
lines the first is judged by the other rules; equal documents get equal results; an empty table gives an empty table;
further columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text, with_length

# Characters that separate words, and that count as symbols.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

# Phrases of page furniture, lower case, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "javascript is disabled", "enable javascript", "click here", "read more", "sign up for our newsletter",
    "subscribe to our", "lorem ipsum", "skip to content", "add to cart", "share this page", "back to top",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "allgemeine geschäftsbedingungen", "hier klicken", "weiterlesen", "in den warenkorb", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "cliquez ici", "lire la suite", "ajouter au panier", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "haga clic aquí", "leer más", "añadir al carrito", "ir al contenido",
)
NAVIGATION = re.compile(r"(?:^|\s)[|»›•·>]+(?=\s|$)")
PUNCTUATION = re.compile(r"[.,;:!?…。！？，、؟।\"'”»)\]]")
END = re.compile(r"[.!?:;…。！？؟।\"'”»)\]]\s*$")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule that follows."""

    min_words: int = 50
    repeat_share: float = 0.5
    symbol_share: float = 0.1
    shout_share: float = 0.6
    shout_words: int = 5
    menu_separators: int = 4
    boilerplate_words: int = 30
    unpunctuated_words: int = 60
    fragment_words: int = 4
    fragment_chars: int = 30
    max_loss: float = 0.4


def line_fails(line: str, words: list[str], rules: LineRules) -> str | None:
    """The name of the first rule that the line breaks."""
    chars = sum(map(len, words))
    if sum(map(line.count, SYMBOLS)) > rules.symbol_share * chars:
        return "symbols"
    if len(NAVIGATION.findall(line)) >= max(rules.menu_separators, len(words) // 4):
        return "navigation"
    if len(words) >= rules.shout_words and not line.islower():
        letters = [w for w in words if any(map(str.isalpha, w))]
        if sum(w.isupper() and len(w) > 1 for w in letters) > rules.shout_share * max(1, len(letters)):
            return "shouting"
    if len(words) <= rules.boilerplate_words:
        low = line.lower()
        if any(x in low for x in BOILERPLATE):
            return "boilerplate"
    elif len(words) >= rules.unpunctuated_words and not PUNCTUATION.search(line):
        return "punctuation"
    if len(words) <= rules.fragment_words and sum(map(len, words)) <= rules.fragment_chars and not END.search(line):
        return "punctuation"  # a label or a heading, not a sentence
    return None


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    counts, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def judge(text: str, rules: LineRules) -> tuple:
    """Statistics and verdict of one text, and the text without the lines that failed."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at the six characters of SPACES
    n_words, word_chars = len(words), len(text) - sum(map(text.count, SPACES))
    n_repeat = repeated_words(words)
    kept_lines, seen, n_dup, lost, failed = [], set(), 0, 0, Counter()
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        why = None
        if line in seen:
            n_dup += 1
            why = "repeated"
        seen.add(line)
        why = why or line_fails(line, own, rules)
        if why:
            failed[why] += 1
            lost += sum(map(len, own))
        else:
            kept_lines.append(line)
    base_failed = n_words < rules.min_words or n_repeat > rules.repeat_share * n_words
    kept = not base_failed and lost <= rules.max_loss * word_chars
    reason = "base" if base_failed else None if kept else failed.most_common(1)[0][0]
    return n_words, word_chars, sum(map(text.count, SYMBOLS)), n_dup, n_repeat, base_failed, kept, lost, reason, "\n".join(kept_lines)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, reason string"
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row for each input row: its id, the statistics, the verdict, and cleaned_text if with_text."""
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["cleaned_text"] * with_text
    types = TYPES + [pa.string()] * with_text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t, rules)[: len(names)] for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(whole_text(df, id_col, text_col), run, f"`{id_col}` {kind}, {FIELDS}" + ", cleaned_text string" * with_text)


def keep_documents(df: DataFrame, text_col: str = "text", length_col: str = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """Rows of df that are kept, with their cleaned text and its length; other columns stay as they are."""
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        judged = [judge(t or "", rules) for t in batch.column(at).to_pylist()]
        columns = batch.columns
        columns[at] = pa.array([x[9] for x in judged], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([x[6] for x in judged], pa.bool_()))

    places = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may need quotes
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema))
    out = map_rows(places, run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))
    return with_length(out, text_col, length_col)
