"""Operator 3, quality rules by line-first cleaning. DataFrame functions only, one pass, no shuffle.

Every rule looks at one line (two of them also at its neighbours and equals); failing lines are removed; a document that loses too
much of its text is rejected. A line with a word fails by
  punctuation  too many symbols for its words, or mostly shouted words ("!!");
  navigation   a menu (bars or bullets between few words), mostly links, or a run of MENU_RUN adjacent lines of MENU_WORDS words at
               most that don't end as sentences do;
  boilerplate  a short line with a phrase of BOILERPLATE, or a line that stands above twice already.

Base counts follow fixed definitions. Repeated windows are told by 64-bit hashes and places, then by their words; equal windows are
only missed if another one of the same hash lies between them. Edge cases: null text counts as empty; an empty document has zero
counts and fails the base rules; a text of any length is one row and takes n log n steps; repeated rows are judged alike; rows may
carry any further columns (with dots or spaces in their names, too), which are kept unless they have the name of a result column,
which then is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD, let

#: Fixed values of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, SYMBOLS = 50, 50, 3, "[#*$%&|<>]"
BLANK, BLANKS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
#: The method's limits: symbols per 100 words of a line, bars and bullets of a menu line, shares of shouted words and of links, lost text.
MAX_SYMBOL_PERCENT, MENU_BARS, MENU_BULLETS, MAX_SHOUT_PERCENT, MAX_LINK_PERCENT, MAX_LOST_PERCENT = 30, 3, 2, 50, 50, 30
#: Lines of a menu with one entry a line, and their words at most; ends of sentences; copies of a line that may stand.
MENU_RUN, MENU_WORDS, ENDS, COPIES = 4, 4, ".!?…:;,)]}>\"'”’»。！？", 2
BULLETS, LINK = "[›•·→]", r"(?:https?://|www\.)[^\x20\x09-\x0D]*"
#: A line of at most BOILER_WORDS words that holds one of these is boilerplate.
BOILER_WORDS = 25
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "subscribe to our newsletter", "sign up for our", "click here to", "share on facebook", "follow us on", "skip to content",
    "back to top", "lorem ipsum", "read more »", "add to cart", "log in to comment",
)
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines", "n_removed_lines")


def _repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more. Equal windows meet by sorting hashes with places in their low bits."""
    shift = lambda way, x, bits: F.call_function(f"shift{way}", x, bits)
    hashes = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(h: Column, bits: Column) -> Column:
        place = lambda x: x.bitwiseAND(shift("left", F.lit(1).cast("long"), bits) - 1).cast("int")
        equal = lambda p, r: (F.get(words, p) == F.get(words, r)) & (F.get(words, p + 1) == F.get(words, r + 1)) & (F.get(words, p + 2) == F.get(words, r + 2))
        both = lambda x, y: F.when((shift("right", x, bits) == shift("right", y, bits)) & equal(place(x), place(y)), F.array(place(x), place(y)))
        twice = let(F.sort_array(F.transform(h, lambda x, i: shift("left", x, bits) + i)), lambda s: F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), both), lambda x: x.isNotNull()))
        steps = lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return let(F.sort_array(F.flatten(twice)), lambda p: F.aggregate(steps(p), F.lit(0), lambda total, x: total + x))

    bits = F.ceil(F.log2(F.size(words) + F.lit(2))).cast("int")
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(bits, lambda b: covered(h, b))))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0)


def _line_fails(line: Column, n: Column) -> Column:
    """The rules that need nothing but the line; n: its words."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    phrases = F.array(*map(F.lit, BOILERPLATE))
    holds = lambda *marks: functools.reduce(lambda x, y: x | y, (F.contains(line, F.lit(m)) for m in marks))
    share = lambda pattern, percent: count(pattern) * 100 >= n * percent
    # a look for the mark spares most lines the regular expression
    shouted = holds("!!") & share(r"!!(?![^\x20\x09-\x0D])", MAX_SHOUT_PERCENT)
    menu = holds("|") & (count(r"\|") >= F.greatest(F.lit(MENU_BARS), n / 3)) | holds(*BULLETS[1:-1]) & (count(BULLETS) >= F.greatest(F.lit(MENU_BULLETS), n / 3))
    links = holds("://", "www.") & share(LINK, MAX_LINK_PERCENT)
    boiler = (n <= BOILER_WORDS) & let(F.lower(line), lambda low: F.exists(phrases, lambda p: F.contains(low, p)))
    return (n > 0) & (shouted | menu | links | (count(SYMBOLS) * 100 > n * MAX_SYMBOL_PERCENT) | boiler)


def _is_entry(line: Column, n: Column) -> Column:
    """A line that may be an entry of a menu."""
    return n.between(1, MENU_WORDS) & ~F.contains(F.lit(ENDS), F.substring(F.rtrim(line, F.lit(BLANK)), -1, 1))


def _late(seen: Column) -> Column:
    """For each line whether COPIES equal ones stand above it. Equal lines meet by sorting them with their places."""
    placed = F.sort_array(F.transform(seen, lambda s, i: F.struct(s["line"].alias("line"), i.alias("at"), s["n"].alias("n"))))
    flag = lambda x, late: F.struct(x["at"].alias("at"), late.alias("late"))
    later = lambda s: F.zip_with(F.slice(s, COPIES + 1, F.size(s)), F.slice(s, F.lit(1), F.greatest(F.size(s) - COPIES, F.lit(0))), lambda x, y: flag(x, (x["line"] == y["line"]) & (x["n"] > 0)))
    flags = let(placed, lambda s: F.sort_array(F.concat(F.transform(F.slice(s, 1, COPIES), lambda x: flag(x, F.lit(False))), later(s))))
    return F.transform(flags, lambda x: x["late"])


def _judged(text: Column) -> Column:
    """Counts of lines and the text without those that fail."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: let(F.regexp_count(x, F.lit(WORD)), lambda n: F.struct(x.alias("line"), n.alias("n"), _line_fails(x, n).alias("bad"), _is_entry(x, n).alias("entry"))))
    pad = "0" * (MENU_RUN - 1)

    def removed(seen: Column, dup: Column) -> Column:
        flags = F.concat(F.lit(pad), F.array_join(F.transform(seen, lambda s: F.when(s["entry"], "1").otherwise("0")), ""), F.lit(pad))
        run = lambda f, i: F.contains(F.substr(f, i + 1, F.lit(2 * MENU_RUN - 1)), F.lit("1" * MENU_RUN))
        menus = let(flags, lambda f: F.when(F.contains(f, F.lit("1" * MENU_RUN)), F.transform(seen, lambda s, i: s["entry"] & run(f, i))))
        late = F.when(dup >= COPIES, _late(seen))
        told = lambda m, k: F.transform(seen, lambda s, i: F.struct(s["line"].alias("line"), (s["bad"] | F.coalesce(F.get(m, i), F.lit(False)) | F.coalesce(F.get(k, i), F.lit(False))).alias("bad")))
        return let(menus, lambda m: let(late, lambda k: told(m, k)))

    def result(seen: Column, dup: Column) -> Column:
        return let(removed(seen, dup), lambda out: let(F.filter(out, lambda x: x["bad"]), lambda bad: F.struct(
            F.size(seen).alias("n_lines"), dup.alias("n_dup_lines"), F.size(bad).alias("n_removed_lines"),
            F.when(F.size(bad) == 0, text).otherwise(F.array_join(F.transform(F.filter(out, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")).alias("clean_text"),
            F.when(F.size(bad) == 0, 0).otherwise(F.length(F.regexp_replace(F.array_join(F.transform(bad, lambda x: x["line"]), " "), BLANKS, ""))).alias("lost"),
        )))

    full = lambda seen: F.transform(F.filter(seen, lambda s: s["n"] > 0), lambda s: s["line"])
    return let(lines, lambda seen: let(let(full(seen), lambda x: F.size(x) - F.size(F.array_distinct(x))), lambda dup: result(seen, dup)))


def apply(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds RESULT to docs. clean_text is the text without the lines that fail; kept is the verdict."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    rest = [c for c in docs.columns if c not in RESULT]
    out = docs.select(*(F.col(f"`{c}`") for c in rest), counted.alias("_c"), let(t, _judged).alias("_l"), F.regexp_count(t, F.lit(SYMBOLS)).alias("n_symbols"))
    n, r, chars = F.col("_c.n_words"), F.col("_c.n_repeat_words"), F.col("_c.word_chars")
    failed = (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)
    return out.select(
        *(F.col(f"`{c}`") for c in rest), n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("_l.n_dup_lines").cast("long").alias("n_dup_lines"), r.cast("long").alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (F.col("_l.lost").cast("long") * 100 <= chars.cast("long") * MAX_LOST_PERCENT)).alias("kept"),
        F.col("_l.clean_text").alias("clean_text"), F.col("_l.n_lines").cast("long").alias("n_lines"), F.col("_l.n_removed_lines").cast("long").alias("n_removed_lines"),
    )
