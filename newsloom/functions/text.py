"""Column functions over article text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters removed when a string is stripped.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: everything but Latin letters, Spanish accents and whitespace of
# every kind. The Unicode flag also makes the class several times faster.
NOT_LETTERS = r"(?U)[^a-zA-ZáéíóúÁÉÍÓÚñÑ\s\x1c-\x1f]"
SPACES = r"(?U)[\s\x1c-\x1f]+"

# Ordered place-name rules (trigger, find, replacement).
PLACE_NAME_RULES = (
    ("Radio Bío", "Radio Bío", "Radio Bío-Bío"),
    (" Bío ", "Bío", "Bío-Bío"),
)

# Fixed value: characters of text that suit one summariser input.
CHUNK_CHARS = 390

_STRINGS = "array<string>"
#: Finished chunks per block of a fold.
_BLOCK = 256


def let(value: Column, body) -> Column:
    """Bind `value` once for use in several places of `body`, or inside a lambda.

    A lambda computes an outside expression anew for every element; a bound
    value is computed once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def text_or_empty(text: Column) -> Column:
    """A missing text counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, NOT_LETTERS, "")


def sentences(body: Column) -> Column:
    """Parts between full stops, unstripped, without the empty ones."""
    return F.filter(F.split(body, "\\."), lambda part: F.length(part) > 0)


def greedy_chunks(parts: Column, size: int = CHUNK_CHARS) -> Column:
    """Join consecutive parts with '. ' until the next one would reach `size`.

    The separator in front of the next part is not counted, a part longer than
    `size` stays whole, and a first part of `size` or more leaves an empty
    chunk in front of it. One fold per array, no shuffle. Finished chunks are
    gathered in blocks: adding to an array copies it, so a long text's chunks
    in one array would be copied once per chunk.
    """
    start = F.struct(
        F.array().cast(f"array<{_STRINGS}>").alias("blocks"),
        F.array().cast(_STRINGS).alias("done"),
        F.lit("").alias("open"),
        F.lit(False).alias("started"),
    )

    def step(state: Column, part: Column) -> Column:
        full = F.length(state["open"]) + F.length(part) >= size
        return F.when(
            full,
            let(
                F.concat(state["done"], F.array(state["open"])),
                lambda done: F.when(
                    F.size(done) < _BLOCK,
                    F.struct(state["blocks"].alias("blocks"), done.alias("done"), part.alias("open"), F.lit(True).alias("started")),
                ).otherwise(
                    F.struct(
                        F.concat(state["blocks"], F.array(done)).alias("blocks"),
                        F.array().cast(_STRINGS).alias("done"),
                        part.alias("open"),
                        F.lit(True).alias("started"),
                    )
                ),
            ),
        ).otherwise(
            F.struct(
                state["blocks"].alias("blocks"),
                state["done"].alias("done"),
                F.when(state["started"], F.concat(state["open"], F.lit(". "), part))
                .otherwise(part)
                .alias("open"),
                F.lit(True).alias("started"),
            )
        )

    def finish(state: Column) -> Column:
        rest = F.when(
            state["started"], F.concat(state["done"], F.array(state["open"]))
        ).otherwise(state["done"])
        return F.concat(F.flatten(state["blocks"]), rest)

    return F.aggregate(F.transform(parts, strip), start, step, finish)


def fixed_chunks(parts: Column, per_group: Column) -> Column:
    """Groups of `per_group` parts, `ceil(parts / per_group - 0.5)` of them.

    A tail of at most half a group is dropped. Empty where `per_group` is 0.
    """
    def grouped(items: Column) -> Column:
        groups = F.ceil(F.size(items) / per_group - 0.5).cast("int")
        joined = F.transform(
            F.sequence(F.lit(0), groups - 1),
            lambda i: F.array_join(F.slice(items, i * per_group + 1, per_group), ". "),
        )
        return (
            F.when(items.isNull(), None)
            .when((per_group > 0) & (groups > 0), joined)
            .otherwise(F.array().cast(_STRINGS))
        )

    return let(parts, grouped)


def group_size(body: Column, chars: int = CHUNK_CHARS) -> Column:
    """Parts per group for `fixed_chunks`: whole multiples of `chars` in the text."""
    return F.floor(F.length(body) / chars).cast("int")


def pair_chunks(parts: Column) -> Column:
    """Join neighbours two by two; an odd last one stays alone."""

    def paired(items: Column) -> Column:
        last = F.floor((F.size(items) - 1) / 2).cast("int")
        joined = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(items, i * 2 + 1, 2), ". "),
        )
        return (
            F.when(items.isNull(), None)
            .when(F.size(items) > 0, joined)
            .otherwise(F.array().cast(_STRINGS))
        )

    return let(parts, paired)


def close_chunks(chunks: Column) -> Column:
    """Put the full stop back and strip."""
    return F.transform(chunks, lambda c: strip(F.concat(c, F.lit("."))))


def mean_part_length(body: Column) -> Column:
    """Mean length of the parts between full stops, empty parts included."""
    parts = F.split(body, "\\.")
    # Every part counts, so the lengths add up to the text without its stops.
    total = F.length(F.replace(body, F.lit("."), F.lit("")))
    return F.when(body.isNull(), None).otherwise(total / F.size(parts))


def place_names(text: Column, rules=PLACE_NAME_RULES) -> Column:
    """Ordered conditional replacements; a later rule sees an earlier result."""
    for trigger, find, replacement in rules:
        text = F.when(
            F.contains(text, F.lit(trigger)),
            F.replace(text, F.lit(find), F.lit(replacement)),
        ).otherwise(text)
    return text


def words(text: Column) -> Column:
    """Whitespace-separated words of a letters-only text."""
    return F.filter(F.split(text, SPACES), lambda w: F.length(w) > 0)


def drop_stop_words(text: Column, stop_words: list[str]) -> Column:
    """Lower-case letters-only text without stop words, joined by a space."""
    kept = F.filter(words(letters_only(F.lower(text))), lambda w: ~w.isin(stop_words))
    return F.array_join(kept, " ")


def bullets(summary: Column) -> Column:
    """The parts of a summary between full stops, as the split leaves them."""
    return F.split(summary, "\\.")


def summary_prompt(title: Column, body: Column) -> Column:
    """Input text for a hosted summariser: the format rules and the article."""
    return F.concat(F.lit(PROMPT_RULES), F.lit('Artículo: "'), title, F.lit(" "), body, F.lit('"'))


# The format a summary must follow, and the rules in the prompt.
MAX_BULLETS = 5
MAX_WORDS = 100
PROMPT_RULES = (
    "Resume la noticia con un título y un punto por línea: "
    f"{MAX_BULLETS} puntos como máximo, {MAX_WORDS} palabras en total, palabras simples.\n"
)
