"""Patterns over classes of words, with optional and repeated parts.

A pattern is a row of parts: ``N`` one word of class N, ``[NA]`` of either class, ``.`` any word, each
with ``?``, ``*`` or ``+`` behind it where it is optional or repeated. It is compiled to the positions
that may follow each other (an automaton without empty moves, one bit for each part), and the automaton
runs inside Column expressions, so sentences never leave the JVM. All spans that match are found; of
overlapping ones the longest stays, the first of equal ones.

Classes come from short lists of function words and from endings: N noun, A adjective, V verb, R adverb,
D determiner, P preposition, B a form of be, H of have, C of can, X negation, T the search term. A
lexicon (word to class) may say otherwise.

The search terms are rows of a table, so a thousand terms are one plan: sentences are joined to the
terms whose first word they have, and each of a sentence's occurrences of a term becomes one word.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.runtime import checked_broadcast

#: Function words of each class.
CLOSED = {
    "D": ("the", "a", "an", "this", "that", "these", "those", "each", "every", "some", "any", "no", "all", "both", "its", "his", "her", "their", "our", "my", "your"),
    "P": ("of", "in", "on", "at", "by", "for", "with", "from", "to", "into", "over", "under", "about", "after", "before", "between", "through", "during", "within", "without"),
    "B": ("be", "is", "are", "was", "were", "been", "being", "am"),
    "H": ("have", "has", "had", "having"),
    "C": ("can", "could"),
    "X": ("not", "never", "n't"),
    "O": ("and", "or", "but", "if", "as", "than", "because", "while", "it", "they", "we", "i", "you", "he", "she", "who", "which", "what", "will", "would", "shall", "should", "may", "might", "must"),
}
#: Endings of the open classes; the first that fits decides, other words are nouns.
ENDINGS = (("R", "ly$"), ("V", "(ing|ed|ise|ize|ify|ate)$"), ("A", "(ous|ive|able|ible|ful|less|ish|ic|al|ary)$"))

#: The phrases looked for around a term T.
PHRASES = {
    "term_noun": "T N N?",
    "noun_phrase": "A* N N? T",
    "adj_phrase": "R* A A* N? T",
    "term_is": "T B X? [RD]* [NA]*",
    "term_have": "T H X? [RD]* [NA]*",
    "term_can": "T C X? [RD]* [NA]*",
    "term_is_at": "T B P D N",
    "verb_obj": "[NARV]? [NARV]? V .? T",
    "verb_subj": "T V [NARV]? [NARV]?",
}
#: Determiners and adjectives before nouns.
NOUN_CHUNK = "D? A* N+"
#: The word that an occurrence of a term becomes while patterns are matched.
TERM = "\x01"


def word_class(word: Column, lexicon: Mapping[str, str] | None = None) -> Column:
    """The class letter of a lower-case word."""
    out = F.when(word == TERM, "T")
    for letter, words in ({} if not lexicon else {c: [w for w, x in lexicon.items() if x == c] for c in sorted(set(lexicon.values()))}).items():
        out = out.when(word.isin(list(words)), letter)
    for letter, words in CLOSED.items():
        out = out.when(word.isin(list(words)), letter)
    for letter, ending in ENDINGS:
        out = out.when(word.rlike(ending), letter)
    return out.otherwise("N")


class Pattern:
    """The automaton of a pattern: bit s stands for part s.

    A pattern that ends with the term runs backwards, from the few places that the term has.
    """

    def __init__(self, text: str):
        parts = re.findall(r"(\[[A-Z]+\]|[A-Z.])([?*+]?)", text)
        if not parts or re.sub(r"(\[[A-Z]+\]|[A-Z.])[?*+]?|\s", "", text):
            raise ValueError(f"not a pattern: {text!r}")
        self.backwards = parts[-1] == ("T", "") and parts[0] != ("T", "")
        if self.backwards:
            parts = parts[::-1]
        self.classes = [None if c == "." else c.strip("[]") for c, _ in parts]
        empty, again = [op in ("?", "*") for _, op in parts], [op in ("*", "+") for _, op in parts]
        if all(empty):
            raise ValueError(f"the pattern matches nothing at all: {text!r}")

        def reach(start: int) -> int:
            mask = 0
            for s in range(start, len(parts)):
                mask |= 1 << s
                if not empty[s]:
                    break
            return mask

        self.first = reach(0)
        self.follow = [reach(s + 1) | (1 << s if again[s] else 0) for s in range(len(parts))]
        self.last = sum(1 << s for s in range(len(parts)) if all(empty[s + 1 :]))

    def fits(self, letter: Column) -> Column:
        """The parts that a word of a class may be, as bits."""
        bits = [F.lit(1 << s) if c is None else F.when(letter.isin(list(c)), 1 << s).otherwise(0) for s, c in enumerate(self.classes)]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    def spans(self, letters: Column) -> Column:
        """All matching spans of an array of class letters, as structs of ``start`` and ``end`` (exclusive).

        A run from a start ends before the first word that fits no part at all.
        """
        fits = F.transform(F.reverse(letters) if self.backwards else letters, self.fits)

        def step(acc: Column, x: Column) -> Column:
            hit = acc["active"].bitwiseAND(x)
            after = F.lit(0)
            for s, follow in enumerate(self.follow):
                after = after.bitwiseOR(F.when(hit.bitwiseAND(1 << s) != 0, follow).otherwise(0))
            at = acc["at"] + 1
            ends = F.when(hit.bitwiseAND(self.last) != 0, F.concat(acc["ends"], F.array(at))).otherwise(acc["ends"])
            return F.struct(after.alias("active"), at.alias("at"), ends.alias("ends"))

        def of(start: Column) -> Column:
            rest = F.slice(fits, start + 1, F.size(fits))
            stop = F.array_position(rest, F.lit(0)).cast("int")
            run = F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)
            found = F.aggregate(run, F.struct(F.lit(self.first).alias("active"), start.alias("at"), F.array().cast("array<int>").alias("ends")), step)
            return F.transform(found["ends"], lambda end: F.struct(start.alias("start"), end.alias("end")))

        starts = F.filter(F.sequence(F.lit(0), F.size(fits) - 1), lambda i: F.get(fits, i).bitwiseAND(self.first) != 0)
        found = F.flatten(F.transform(starts, of))
        if self.backwards:
            found = F.transform(found, lambda s: F.struct((F.size(letters) - s["end"]).alias("start"), (F.size(letters) - s["start"]).alias("end")))
        return F.when(F.size(letters) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def longest_spans(spans: Column) -> Column:
    """Spans without overlaps: the longest first, of equal ones the first; in the order of the text."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    kept = F.aggregate(ordered, none, lambda acc, s: F.when(F.exists(acc, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    return F.array_sort(kept)


def with_terms(sentences: DataFrame, keys: list[str], words: str, terms: DataFrame, term: str) -> DataFrame:
    """``keys, term, words`` for each sentence and term that it has: words with every occurrence of the
    term, from left to right and without overlaps, made one word ``TERM``.

    Sentences are joined on the term's first word; the whole term is looked for only then.
    """
    split = terms.select(F.col(term).alias("term"), F.filter(F.split(F.lower(term), r"[\s_-]+"), lambda w: w != "").alias("term_words")).where(F.size("term_words") > 0).distinct()
    split = split.withColumn("first", F.get("term_words", F.lit(0)))
    opened = sentences.select(*keys, F.col(words).alias("words"), F.explode(F.array_distinct(words)).alias("first"))
    wrap = lambda ws: F.array_join(F.transform(ws, lambda w: F.concat(F.lit("\x02"), w, F.lit("\x03"))), "")
    found = opened.join(checked_broadcast(split, limit=50_000), "first").withColumn("line", wrap(F.col("words"))).where(F.contains("line", wrap(F.col("term_words"))))
    line = F.replace("line", wrap(F.col("term_words")), F.lit(f"\x02{TERM}\x03"))
    made = F.split(F.trim(F.translate(line, "\x02\x03", "  ")), " +")
    return found.select(*keys, "term", made.alias("words"))


def term_phrases(sentences: DataFrame, keys: list[str], words: str, terms: DataFrame, term: str, phrases: Mapping[str, str] = PHRASES, lexicon: Mapping[str, str] | None = None) -> DataFrame:
    """``keys, term, pattern, start, end, phrase``: the longest matches of each pattern around each term.

    Places count words, an occurrence of the term as one.
    """
    rows = with_terms(sentences, keys, words, terms, term)
    rows = rows.withColumn("letters", F.transform("words", lambda w: word_class(w, lexicon)))

    def hits(name: str, pattern: str) -> Column:
        spans = longest_spans(Pattern(pattern).spans(F.col("letters")))
        return F.transform(spans, lambda s: F.struct(F.lit(name).alias("pattern"), s["start"].alias("start"), s["end"].alias("end")))

    each = [hits(name, p) for name, p in phrases.items()]
    found = rows.select(*keys, "term", "words", F.inline_outer(F.concat(*each))).where(F.col("pattern").isNotNull())
    text = F.replace(F.array_join(F.slice("words", F.col("start") + 1, F.col("end") - F.col("start")), " "), F.lit(TERM), F.lower("term"))
    return found.select(*keys, "term", "pattern", "start", "end", text.alias("phrase"))


def noun_chunks(sentences: DataFrame, keys: list[str], words: str, pattern: str = NOUN_CHUNK, lexicon: Mapping[str, str] | None = None) -> DataFrame:
    """``keys, n, phrase``: runs of determiners, adjectives and nouns from left to right, each as long as
    it can be, numbered from 0.

    The pattern is a regular expression over one letter for each word. What it finds is put in brackets,
    and the brackets are carried over to the words; so a sentence is passed over once, however long it is.
    """
    letters = F.array_join(F.transform(words, lambda w: word_class(w, lexicon)), "")
    marked = F.regexp_extract_all(F.regexp_replace(letters, pattern.replace(" ", ""), "<$0>"), F.lit("<?[A-Z]>?"), F.lit(0))
    text = F.array_join(F.zip_with(words, marked, lambda w, m: F.concat(F.when(F.startswith(m, F.lit("<")), "\x02").otherwise(""), w, F.when(F.endswith(m, F.lit(">")), "\x03").otherwise(" "))), "")
    found = F.regexp_extract_all(text, F.lit("\x02([^\x03]*)\x03"), F.lit(1))
    return sentences.select(*keys, F.posexplode_outer(found).alias("n", "phrase")).where(F.col("phrase").isNotNull())


def chunks_with(chunks: DataFrame, terms: DataFrame, term: str, phrase: str = "phrase") -> DataFrame:
    """Chunks that hold a term as whole words, with the term: joined on the term's first word."""
    split = terms.select(F.col(term).alias("term"), F.get(F.split(F.lower(term), " "), F.lit(0)).alias("first"), F.concat(F.lit(" "), F.lower(term), F.lit(" ")).alias("whole")).distinct()
    opened = chunks.select("*", F.explode(F.array_distinct(F.split(phrase, " "))).alias("first"))
    found = opened.join(checked_broadcast(split, limit=50_000), "first")
    return found.where(F.contains(F.concat(F.lit(" "), phrase, F.lit(" ")), F.col("whole"))).drop("first", "whole")
