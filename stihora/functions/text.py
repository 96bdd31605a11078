"""Text functions: columns in, columns out, all inside the JVM.

Null in gives null out unless a function says otherwise.  Patterns use
explicit classes such as \\p{L}, which mean the same in other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "аеиоу"
#: White space of any script, spelled out because \\s differs between engines.
WS = r"[\s\x0B\x85\p{Z}]"
LETTERS, WORD_CHARS, NON_SPACE = r"\p{L}+", r"[\p{L}\p{N}_]+", r"[^\s\x0B\x85\p{Z}]+"


def trimmed(text: Column) -> Column:
    """A text without outer white space of any kind."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def words(text: Column, pattern: str = LETTERS) -> Column:
    """Lower-case words of a text (by default runs of letters)."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space, as written."""
    return F.regexp_extract_all(text, F.lit(NON_SPACE), 0)


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), trimmed), lambda x: x != "")


def stanzas(text: Column) -> Column:
    """Blocks between blank lines that are not blank themselves."""
    return F.filter(F.split(trimmed(text), "\n\n"), lambda x: trimmed(x) != "")


def trim_lines(text: Column) -> Column:
    """The text with every line trimmed."""
    return F.array_join(F.transform(F.split(text, "\n"), trimmed), "\n")


def rhyme_ending(line: Column, vowels: str = VOWELS) -> Column:
    """Ending of a line's last word of letters that has a vowel, from behind the vowel before its last one; null if none has."""
    v = f"[{vowels}]"
    n = f"[^{vowels}]"
    stripped = F.transform(F.split(F.lower(line), f"{WS}+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    word = F.try_element_at(F.filter(stripped, lambda w: w.rlike(r"^\p{L}+$") & w.rlike(v)), F.lit(-1))
    return F.when(word.rlike(f"{v}.*{v}"), F.regexp_extract(word, f"{v}({n}*{v}{n}*)$", 1)).otherwise(F.regexp_extract(word, f"({v}{n}*)$", 1))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a blank; empty if there are fewer.

    Shifted slices are zipped, so the cost is linear in the tokens.
    """
    m = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), m)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(k + 1), m), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def distinctness(tokens: Column, n: int) -> Column:
    """Share of different n-grams among all; 0 without any."""
    return F.size(F.array_distinct(ngrams(tokens, n))) / F.greatest(F.size(tokens) - (n - 1), F.lit(1))


def counts(items: Column) -> Column:
    """Map of each item to how often it stands in an array."""
    return F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x, F.size(F.filter(items, lambda y: y == x)))))


def most_repeats(items: Column) -> Column:
    """How often the most frequent item of an array stands in it; 0 for an empty one.

    Equal items are neighbours once the array is sorted, so one pass suffices.
    """
    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["prev"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("prev"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(F.sort_array(items), start, step, lambda acc: acc["most"])


def script_counts(text: Column) -> Column:
    """Struct of the numbers of Cyrillic and Latin letters."""
    return F.struct(F.regexp_count(text, F.lit("[Ѐ-ӿ]")).alias("cyrillic"), F.regexp_count(text, F.lit("[A-Za-z]")).alias("latin"))


def script_ratio(text: Column) -> Column:
    """Share of Cyrillic letters among Cyrillic and Latin ones; 0 without letters."""
    c, n = F.regexp_count(text, F.lit("[Ѐ-ӿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(c + n > 0, c / (c + n)).otherwise(F.lit(0.0))


#: Markup of any kind, and markup of chat answers only.
MARKUP = r"(?m)\*\*|^#{1,6} |^[-*] |^[0-9]+\. |```"
CHAT_MARKUP = r"(?m)\*\*|^#{1,6} |```"


def has_markup(text: Column, chat_only: bool = False) -> Column:
    return text.rlike(CHAT_MARKUP if chat_only else MARKUP)


def content_types(text: Column, least: int = 4) -> Column:
    """Different words of at least so many letters."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= least))


def normalized_line(line: Column) -> Column:
    """A line as its words joined by blanks."""
    return F.array_join(words(line), " ")


def collapsed_line(line: Column) -> Column:
    """A line in lower case with white space collapsed."""
    return F.regexp_replace(trimmed(F.lower(line)), f"{WS}+", " ")


def marker_letters(text: Column, markers: str) -> Column:
    """Sorted set of the marker letters that stand in a text."""
    return F.sort_array(F.array_intersect(F.split(F.lower(text), ""), F.array(*map(F.lit, markers))))


def mask_first(text: Column, word: Column, brackets: bool = False) -> Column:
    """The text with the first occurrence of a word masked, or bracketed; unchanged if it does not occur."""
    at = F.instr(text, word)
    put = F.concat(F.lit("["), word, F.lit("]")) if brackets else F.lit("[MASK]")
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), put, F.substring(text, at + F.length(word), F.length(text)))).otherwise(text)


def splice(text: Column, edits: Column) -> Column:
    """Apply edits (start, end, put; character offsets, end exclusive) to a text, whatever their order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, e: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, e["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, e["put"]).alias("out"), e["end"].cast("int").alias("at"))

    return F.aggregate(F.sort_array(edits), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def near_copy(text: Column, put: str, least_words: int = 4) -> Column:
    """The text with the last word of each line of so many words replaced."""
    return F.array_join(F.transform(lines(text), lambda x: F.when(F.size(F.split(x, f"{WS}+")) >= least_words, F.regexp_replace(x, f"{NON_SPACE}$", put)).otherwise(x)), "\n")


def clean_display(text: Column) -> Column:
    """Line feeds only, no outer white space, at most one blank line in a row."""
    return F.regexp_replace(trimmed(F.regexp_replace(text, "\r\n", "\n")), "\n{3,}", "\n\n")


def strip_reasoning(text: Column) -> Column:
    """The text without its reasoning blocks; empty if one is not closed."""
    done = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.when(F.contains(done, F.lit("<think>")), F.lit("")).otherwise(trimmed(done))


def slug(text: Column) -> Column:
    """A text as part of a file name."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_-]+", "_"), "^_+|_+$", "")


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = json
    for ch in "<>&\u2028\u2029":
        code = f"\\\\u{ord(ch):04x}"
        out = F.regexp_replace(out, ch, code)
    return out


def item_id(*parts: Column) -> Column:
    """Ten hexadecimal digits that stand for the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def cache_key(*parts: Column) -> Column:
    """Content address of the parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def parse_features(text: Column) -> Column:
    """Map of a feature bundle such as A=x|B=y; empty for an empty one."""
    return F.when(text == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.str_to_map(text, F.lit("\\|"), F.lit("=")))


def render_features(features: Column) -> Column:
    """A feature bundle in the order of its names."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(features)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")


#: Features that are dropped one after the other to relax a bundle; gender for nouns only.
DROP_ORDER = ("Polarity", "Case", "Mood", "Degree", "Gender", "Aspect", "Person", "Tense")


def relaxed_features(features: Column, pos: Column) -> Column:
    """Array of ever looser bundles: one more feature is dropped each time, but never the last."""
    order = F.array(*map(F.lit, DROP_ORDER))
    present = F.filter(order, lambda f: F.map_contains_key(features, f) & ((f != "Gender") | (pos == "NOUN")))
    steps = F.least(F.size(present), F.size(features) - 1)
    every = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda k: F.map_filter(features, lambda name, _: ~F.array_contains(F.slice(present, F.lit(1), k), name)))


def has_suffix(word: Column, suffixes: tuple[str, ...]) -> Column:
    return word.rlike(f"({'|'.join(suffixes)})$")
