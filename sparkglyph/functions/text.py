"""Text expressions of the n-gram engine: cutting lines into tokens, and cleaning them. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All white space of Unicode, which Java's \s alone doesn't cover.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
#: What counts as a word.
WORD = "^[a-z']{1,30}$"
#: A line that only names a speaker, and the dash that opens one.
SPEAKER, DASH = r"^[A-Z][a-zA-Z' ]{0,20}:\s*$", r"^-\s*"
#: Curly single quotes, dashes and ellipsis, what stands for them, and curly double quotes, which go.
CURLY, PLAIN = "‘’—–…“”", "''   "
#: Where a sentence ends and the next begins.
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])"
#: The markers around a book's text.
BOOK_START, BOOK_END = r"\*\*\* START OF.*?\*\*\*", r"\*\*\* END OF.*?\*\*\*"
#: Markdown, in the order it goes, and what stands for it.
MARKDOWN = ((r"(?s)```.*?```", " "), (r"`[^`]*`", " "), (r"!\[.*?\]\(.*?\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#+\s*", ""), (r"[*_#>`|-]", " "))
#: A chat user's name in a post.
MENTION = r"\d{1,2}-\d{1,2}-(?:teens|20s|30s|40s|adults)User\d+\.*"
#: Glosses that only name another form of a word.
INFLECTION = r"(?i)^(plural of|alternative (form|spelling) of|obsolete (form|spelling) of|archaic (form|spelling) of|past (tense|participle) of|present participle of|third-person singular of|misspelling of)"
#: The part of speech that a token may end in.
POS_SUFFIX = "_[A-Z.]+$"
#: The five skin tones.
SKIN_TONES = r"[\x{1F3FB}-\x{1F3FF}]"
#: What a line has to hold if it is to have white space other than blanks: anything but these characters.
_ODD = r"[^ -~\xa1-\u167f]"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line (cut at \\n only); null texts have none."""
    return docs.select(F.explode(F.split(text, "\n")).alias("line"))


def tokens(line: Column) -> Column:
    """Lower-cased words of a line; what isn't a word is gone before windows form. Cut at blanks, which needs no regular
    expression; lines that may have other white space get blanks for it first."""
    low = F.lower(line)
    plain = F.when(line.rlike(_ODD), F.regexp_replace(low, SPACE, " ")).otherwise(low)
    return F.filter(F.split(plain, " "), lambda w: w.rlike(WORD))


def raw_words(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def plain_typography(text: Column) -> Column:
    return F.translate(text, CURLY, PLAIN)


def cleaned(rows: DataFrame, least_words: int = 3) -> DataFrame:
    """line, cleaned line and `reason`: kept, label (a speaker's name alone) or short. Blank lines are passed over."""
    bare = strip(F.col("line"))
    clean = strip(F.regexp_replace(bare, DASH, ""))
    reason = F.when(bare.rlike(SPEAKER), "label").when(F.size(raw_words(clean)) < least_words, "short").otherwise("kept")
    return rows.where(bare != "").select("line", clean.alias("clean"), reason.alias("reason"))


def sentences(text: Column) -> Column:
    """Array of sentences of a text whose white space counts as single blanks: cut after . ! or ? and before a capital."""
    return F.split(strip(F.regexp_replace(text, SPACE, " ")), SENTENCE)


def without_boilerplate(text: Column) -> Column:
    """What stands between a book's start and end markers; the text as it is without both."""
    begin, end = F.regexp_instr(text, F.lit(BOOK_START)), F.regexp_instr(text, F.lit(BOOK_END))
    first = begin + F.length(F.regexp_extract(text, BOOK_START, 0))
    return F.when((begin > 0) & (end > 0), F.substring(text, first, F.greatest(end - first, F.lit(0)))).otherwise(text)


def without_markdown(text: Column) -> Column:
    for pattern, plain in MARKDOWN:
        text = F.regexp_replace(text, pattern, plain)
    return text


def without_mentions(text: Column) -> Column:
    return strip(F.regexp_replace(text, MENTION, ""))


def is_inflection(gloss: Column) -> Column:
    return F.coalesce(gloss.rlike(INFLECTION), F.lit(False))


def base_emoji(emoji: Column) -> Column:
    return F.regexp_replace(emoji, SKIN_TONES, "")


def without_pos(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, POS_SUFFIX, ""))


def typed(sentence: Column) -> tuple[Column, Column]:
    """The last completed word, lower-cased, and the letters typed since (none after a blank)."""
    prefix = F.substring_index(sentence, " ", -1)
    return F.lower(F.element_at(F.concat(F.array(F.lit("")), raw_words(F.left(sentence, F.length(sentence) - F.length(prefix)))), -1)), prefix


def trailing_fragment(text: Column) -> Column:
    """Letters, digits and apostrophes that the last 50 characters end in."""
    return F.regexp_extract(F.right(text, F.lit(50)), r"[\p{L}\p{N}']+$", 0)
