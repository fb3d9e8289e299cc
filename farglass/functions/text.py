"""Text cleaning and normalising as Column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight punctuation rules, in their order (bullets and colons to commas; dashes and
# slashes to spaces; curly quotes; other symbols; brackets to commas; full stops run together).
PUNCTUATION_RULES = (
    ("[•,‣,◦,⁃,∙\\:]", ","),
    (r"[-/\\]", " "),
    ("’", "'"),
    (r"[^a-zA-Z0-9,.;' #(++)]", ""),
    (r"\s\(", ", "),
    (r"\)\s", ", "),
    (r"(\))(?!\s)", ""),
    (r"\.{2,}", "."),
)
# Fixed value: what counts as punctuation when it is removed or padded.
PUNCTUATION = r"([^a-zA-Z0-9 #(++)+])"
# Legal forms and general words that company names are compared without.
COMPANY_WORDS = (
    "global international national ltd llp limited holdings group cic uk plc inc gmbh oy srl sa nz co se sarl sl bv doo fmcg llc zao kg kft aps ab as "
    "sro sas ccl sdn bhd ug ek kk kc sp website nbsp hk int rl usa nc sac pvt intl gbr"
).split()


def repair_sentences(text: Column) -> Column:
    """A full stop where a lower-case letter runs into a capitalised word."""
    return F.regexp_replace(text, "([a-z])([A-Z])([a-z])", "$1. $2$3")


def tidy_punctuation(text: Column) -> Column:
    for pattern, new in PUNCTUATION_RULES:
        text = F.regexp_replace(text, pattern, new)
    return text


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " ")


def pad_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " $1 ")


def unpad_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, "( )" + PUNCTUATION, "$2")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def remove_words(text: Column, words: Iterable[str]) -> Column:
    """Without the space-separated words that are in the list."""
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(list(words))), " ")


def singular(word: Column) -> Column:
    """A noun's singular by rule: an approximation of dictionary lemmas."""
    return (
        F.when(word.rlike("(ss|us|is)$") | (F.char_length(word) < 4), word)
        .when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|x|z|ss)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def singulars(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), singular), " ")


def clean_minimal(text: Column, keep_punctuation: bool = True) -> Column:
    """Repair, lower-case, tidy or remove punctuation, collapse; null gives the text "sentence is blank"."""
    low = F.lower(repair_sentences(text))
    done = collapse(tidy_punctuation(low) if keep_punctuation else remove_punctuation(low))
    return F.coalesce(done, F.lit("sentence is blank"))


def clean(text: Column, stop_words: Iterable[str], keep_punctuation: bool = False) -> Column:
    """The full chain: repair, lower-case, punctuation, singulars, stop words."""
    low = F.lower(repair_sentences(text))
    if keep_punctuation:
        words = remove_words(singulars(pad_punctuation(tidy_punctuation(low))), stop_words)
        return collapse(unpad_punctuation(words))
    return collapse(remove_words(singulars(remove_punctuation(low)), stop_words))


def letters_only(text: Column, digits: bool = False) -> Column:
    """ASCII letters (and digits) and single spaces."""
    if digits:
        return F.regexp_replace(text, "[^0-9a-zA-Z ]+", "")
    return collapse(F.regexp_replace(text, "[^a-zA-Z ]+", ""))


def label_text(text: Column) -> Column:
    """A label without what it has in brackets, letters only."""
    return letters_only(F.regexp_replace(text, r"\([^()]*\)", ""))


def join_texts(*texts: Column, separator: str = ". ") -> Column:
    """Texts joined; a null one is empty and keeps its separator."""
    return F.array_join(F.array(*(F.coalesce(t, F.lit("")) for t in texts)), separator)


def drop_determiner(text: Column) -> Column:
    """Without a leading the, a, an, each tried once in that order."""
    for word in ("the", "a", "an"):
        text = F.regexp_replace(text, rf"^{word}\s", "")
    return text


def company_name(name: Column, words: Iterable[str] = COMPANY_WORDS) -> Column:
    """A company name for comparing: lower case, letters and digits, without legal forms."""
    low = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "([a-z])([A-Z])", "$1 $2"), "&", " and "))
    return collapse(remove_words(collapse(F.regexp_replace(F.regexp_replace(low, "['’.]", ""), "[^a-z0-9]+", " ")), words))


def company_key(name: Column) -> Column:
    """ASCII letters and digits of a name, lower-cased; null gives an empty text."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9]", ""))


def website(url: Column, www: bool = False) -> Column:
    """A site without scheme and closing slashes: with ``www.`` in front, or without it and lower-cased
    (null gives an empty text)."""
    if www:
        bare = F.replace(F.replace(F.rtrim(url, F.lit("/")), F.lit("https://")), F.lit("http://"))
        return F.when(F.startswith(bare, F.lit("www.")), bare).otherwise(F.concat(F.lit("www."), bare))
    bare = F.replace(F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("https://")), F.lit("http://")), F.lit("www."))
    return F.lower(F.rtrim(bare, F.lit("/")))


def scrub_description(text: Column, name: Column, generic: str = "This company") -> Column:
    """A description with the company's name made generic, without links, brackets and doubled marks."""
    out = F.when(F.coalesce(name, F.lit("")) != "", F.replace(text, name, F.lit(generic))).otherwise(text)
    for pattern, new in ((r"https?://\S+|www\.\S+", ""), (r"\([^()]*\)|\[[^\[\]]*\]", ""), (r"([.,;:!?])\1+", "$1"), (r"\s+([.,;:!?])", "$1")):
        out = F.regexp_replace(out, pattern, new)
    return collapse(out)


def tokens_to_text(tokens: Column, separator: str = "_", pad: bool = True) -> Column:
    """Tokens with their phrase separators opened, joined by spaces, with a space at the ends."""
    opened = F.array_join(F.flatten(F.transform(tokens, lambda t: F.split(t, separator))), " ")
    return F.concat(F.lit(" "), opened, F.lit(" ")) if pad else opened


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.split(text, " ")))


def clean_date(text: Column, last_year: int = 2500) -> Column:
    """Timestamp of a text with or without a closing Z; far years and bad dates are null."""
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(year <= last_year, F.try_to_timestamp(F.rtrim(text, F.lit("Z"))))


def impute_month(text: Column) -> Column:
    """First day of the month of ``mon/yyyy``; a lone year is its January."""
    full = F.when(text.rlike(r"^\d{4}$"), F.concat(F.lit("jan/"), text)).otherwise(text)
    return F.try_to_timestamp(full, F.lit("MMM/yyyy")).cast("date")


def postcode(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))


def speech_class(speech: Column, heading: Column, current: Column) -> Column:
    """Division or Procedural by how a speech begins or what it is under; else as it was."""
    return (
        F.when(speech.rlike(r"^The House divided: Ayes [0-9]{1,3}, Noes [0-9]{1,3}\."), "Division")
        .when(speech.rlike("^Question,? |^Mr. Speaker forthwith|^Resolved, ?That this House") | heading.isin("MEMBERS SWORN", "Preamble"), "Procedural")
        .otherwise(current)
    )
