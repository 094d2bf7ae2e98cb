"""Quality rules, line first: bad lines go, then documents that lose too much text go.

Native: DataFrame functions only. One narrow pass, no shuffle; each row is judged by itself, so
neither a hot source nor copies matter. Repeated words are found by sorting the hashes of the
five-word windows inside the row, O(n log n) also for the longest texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_PATTERN


@dataclass(frozen=True)
class Rules:
    """Thresholds. A line fails if any line rule holds; a document fails by its base rules or by what its lines lose."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: characters that mark symbol junk, and the share of a line's word characters above which it fails
    max_line_symbol_percent: int = 10
    #: fields between bars or similar separators at or above which a line is navigation
    min_navigation_fields: int = 4
    #: share of the words' characters that failed lines may hold, in percent
    max_lost_percent: int = 50
    #: a boilerplate phrase fails a line of at most so many word characters; in a longer one it is a mention
    max_boilerplate_chars: int = 120
    #: whole words, in lower case
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "click here", "subscribe now", "sign in", "log in", "javascript", "lorem ipsum", "copyright", "licensed under", "share this", "read more",
        "alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "weiterlesen", "jetzt anmelden", "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici", "lire la suite",
        "todos los derechos reservados", "política de privacidad", "aviso legal", "haga clic aquí", "leer más", "tutti i diritti riservati", "informativa sulla privacy", "clicca qui", "leggi tutto",
    )

    def phrases(self) -> str:
        """A pattern that Java and RE2 read alike, case aside."""
        return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(self.boilerplate)})(?:$|[^\p{{L}}\p{{N}}])"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words that lie in a window of ``window`` words which the text holds twice or more."""
    n = F.size(words)
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    keyed = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, i, d: F.coalesce(F.get(s, i + d)["h"] == F.get(s, i)["h"], F.lit(False))
    return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0)).otherwise(_covered(keyed, same, window))


def _covered(keyed: Column, same, window: int) -> Column:
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  binds a value, so that it is computed once
    positions = lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(s, i, -1) | same(s, i, 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))
    span = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    return once(keyed, lambda s: once(positions(s), span))


def symbols(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))


def line_fails(line: Column, rules: Rules = Rules()) -> Column:
    """Of (text, chars, symbols): punctuation (symbol junk, or words without a letter or digit), navigation (short fields between separators), or a boilerplate phrase."""
    fields = F.size(F.split(line["text"], r"[|»›•]"))
    empty = (line["chars"] > 0) & ~line["text"].rlike(r"[\p{L}\p{N}]")
    boilerplate = (line["chars"] <= rules.max_boilerplate_chars) & line["text"].rlike("(?iu)" + rules.phrases())
    return (line["symbols"] * 100 > line["chars"] * rules.max_line_symbol_percent) | empty | (fields >= rules.min_navigation_fields) | boilerplate


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: its base counts, ``base_failed``, ``clean_text`` (lines that pass), ``lost_chars`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Rows are judged alone: repeated rows
    give repeated results, and other columns are ignored whatever their names.
    """
    return _judged(docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), "doc_id", rules)


def clean(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with all their columns; their text is that of the lines that pass.

    Null and empty texts are rejected. Rows are judged alone, so repeated rows give repeated results; other
    columns are carried along whatever their names; an empty table gives an empty result.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    judged = _judged(docs.select(row, F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), "row", rules)
    # a filter would be pushed below the counts and repeat them for every word; it isn't pushed through a generator
    kept = judged.select(F.explode(F.array(F.struct("row", "clean_text", "kept"))).alias("x")).where("x.kept")
    return kept.select(*[F.col("x.clean_text").alias(c) if c == text_col else F.col("x.row").getField(c).alias(c) for c in docs.columns])


def _judged(rows: DataFrame, carried: str, rules: Rules) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), word_chars(x).alias("chars"), symbols(x).alias("symbols")))
    base = rows.withColumns({"words": words_of(F.col("text")), "lines": lines})
    base = base.withColumn("clean", F.filter("lines", lambda x: ~line_fails(x, rules)))
    total = lambda column: F.aggregate(column, F.lit(0), lambda a, x: a + x).cast("long")
    filled = F.filter("lines", lambda x: x["chars"] > 0)["text"]
    counted = base.select(
        carried, "text", F.size("words").cast("long").alias("n_words"), total(F.col("lines")["chars"]).alias("word_chars"), total(F.col("lines")["symbols"]).alias("n_symbols"),
        (F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), rules.window).cast("long").alias("n_repeat_words"),
        F.array_join(F.col("clean")["text"], "\n").alias("clean_text"), total(F.col("clean")["chars"]).alias("clean_chars"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    judged = counted.withColumns({"base_failed": failed, "lost_chars": F.col("word_chars") - F.col("clean_chars")}).drop("clean_chars")
    return judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.max_lost_percent * F.col("word_chars")))
