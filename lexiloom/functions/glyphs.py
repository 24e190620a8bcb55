"""Functions of emoji ids (code points in hexadecimal, joined by `-`), locales, regions and short labels; column functions unless said otherwise."""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Skin tones, and the ids that fold into others.
TONES = {"none": None, "light": "1F3FB", "medium-light": "1F3FC", "medium": "1F3FD", "medium-dark": "1F3FE", "dark": "1F3FF"}
SKIN, GENDER, DIRECTION = "-1F3F[B-F]", "-200D-(2640|2642)(-FE0F)?", "-200D-27A1(-FE0F)?"
#: Locales with a pack, old codes, and locales whose script people also write in Latin letters.
PACK_LOCALES, RENAMED = ["en", "zh", "hi", "es", "ar", "fr", "bn", "pt", "ru", "id", "tr"], {"in": "id"}
ROMANIZED = ["zh", "hi", "ar", "bn", "ru"]
#: Words that say nothing about a picture.
FILLER = "a an the of on in at to and with is are its this that some".split()


def code_points(text: Column) -> Column:
    """The letters' code points, four hexadecimal digits at least, joined by `-`."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) < 0x1000, F.lpad(F.hex(F.ascii(c)), 4, "0")).otherwise(F.hex(F.ascii(c)))), "-")


def id_of(glyph: Column) -> Column:
    """A glyph's id; the variation selector after a single letter goes."""
    return F.regexp_replace(code_points(glyph), "^([0-9A-F]+)-FE0F$", "$1")


def base_id(id_: Column) -> Column:
    return F.regexp_replace(F.upper(id_), SKIN, "")


def without_variation(id_: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(id_, "-FE0F", ""), "^FE0F-", "")


def rating_family(id_: Column) -> Column:
    """The family by which frequency lists count: no tone, no sign of gender at the end, man and woman as person."""
    bare = F.regexp_replace(without_variation(id_), SKIN, "")
    plain = F.when(F.size(F.split(bare, "-")) >= 3, F.regexp_replace(bare, "-200D-(2640|2642)$", "")).otherwise(bare)
    return F.regexp_replace(plain, "^(1F468|1F469)-200D", "1F9D1-200D")


def list_family(id_: Column) -> Column:
    """The family of which a short list shows one member: signs of gender and direction go, man and woman as person."""
    bare = F.regexp_replace(without_variation(id_), f"({DIRECTION}|{GENDER})", "")
    return F.regexp_replace(bare, "^(1F468|1F469)(?=-200D)", "1F9D1")


def is_country_flag(id_: Column) -> Column:
    """Two regional indicators, or a black flag with tags."""
    pair = r"^1F1(E[6-9A-F]|F[0-9A-F])-1F1(E[6-9A-F]|F[0-9A-F])$"
    return id_.rlike(pair) | id_.rlike(r"^1F3F4-E00([2-6][0-9A-F]|7[0-9A-F])-")


@F.pandas_udf(StringType())
def with_tone(glyphs: pd.Series, tones: pd.Series) -> pd.Series:
    """Glyphs in a skin tone: each person or hand takes it, but for a handshake between two people."""
    bases = regex.compile(r"(?<!\u200D(?=\U0001F91D))(\p{Emoji_Modifier_Base})\uFE0F?")
    tone = {k: v and chr(int(v, 16)) for k, v in TONES.items()}
    return pd.Series([g if g is None or not tone.get(t) else bases.sub(lambda m, t=t: m[1] + tone[t], g) for g, t in zip(glyphs, tones, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def clusters(texts: pd.Series) -> pd.Series:
    """The emoji of texts: grapheme clusters that hold a picture, a flag or a keycap."""
    picture = regex.compile(r"\p{Extended_Pictographic}|\p{Regional_Indicator}{2}|\u20E3")
    return texts.map(lambda t: [c for c in regex.findall(r"\X", t) if picture.search(c)] if t is not None else None)


def pack_locale(tag: Column, supported: list[str] | None = None) -> Column:
    """The pack locale of a language tag, null without one."""
    language = F.get(F.split(F.lower(F.trim(tag)), "[-_]"), F.lit(0))
    for old, new in RENAMED.items():
        language = F.when(language == old, new).otherwise(language)
    return F.when(language.isin(supported or PACK_LOCALES), language)


def user_locales(tags: Column, supported: list[str] | None = None) -> Column:
    """The pack locales of a user's language tags, in order and each once, and English."""
    own = F.array_distinct(F.array_compact(F.transform(tags, lambda t: pack_locale(t, supported))))
    return F.array_union(own, F.array(F.lit("en")))


def region_of(tag: Column) -> Column:
    """The region of a language tag: two letters after the language and an optional script."""
    found = F.regexp_extract(F.replace(tag, F.lit("_"), F.lit("-")), r"(?i)^[a-z]{2,3}(?:-[a-z]{4})?-([a-z]{2})(?:-|$)", 1)
    return F.when(found != "", F.upper(found))


def resolved_region(asked: Column, device: Column) -> Column:
    """A caller's region: the device's where it isn't given or is `device`, none where it is empty."""
    return F.when(asked.isNull() | (F.lower(asked) == "device"), device).when(asked != "", asked)


def is_romanized(locale: Column, q: Column) -> Column:
    """Latin letters only, in a locale with another script."""
    return locale.isin(ROMANIZED) & q.rlike(r"\p{L}") & ~q.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def caption_keywords(words: Column, most: int = 6) -> Column:
    """The first telling words of a caption's tokens, each once."""
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(FILLER))), 1, most)


def autocomplete(text: Column) -> Column:
    """What is being typed after a colon at the end of a text, null where no search starts there: the colon stands at a start, after a blank or a bracket."""
    typed = F.regexp_extract(text, r"(?:^|[\s(]):([^\s:]*)$", 1)
    return F.when(text.rlike(r"(?:^|[\s(]):([^\s:]*)$"), typed)


def finished_shortcode(text: Column) -> Column:
    """The name of a `:name:` right at the end of a text, or null."""
    found = F.regexp_extract(text, r"(?:^|[\s(]):([^\s:]+):$", 1)
    return F.when(found != "", found)


def clauses(text: Column) -> Column:
    """The text and its clauses of two words at least, cut at punctuation before a blank, brackets, quotes, emoji and conjunctions."""
    cut = r"[.!?,;:]+(?=\s|$)|[\n()\x{22}\x{201C}\x{201D}`\x{A1}\x{BF}]+|[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}]+|\s(?:and|but|so)\s"
    parts = F.transform(F.split(text, cut), lambda x: F.trim(x))
    return F.array_distinct(F.concat(F.array(text), F.filter(parts, lambda x: F.size(F.split(x, r"\s+")) >= 2)))


def truncated(text: Column, length: int) -> Column:
    """At most so many letters; a letter is never cut."""
    return F.left(text, F.lit(length))


@F.pandas_udf(StructType([StructField("caption", StringType()), StructField("keywords", ArrayType(StringType())), StructField("glyphs", ArrayType(StringType()))]))
def parsed_label(answers: pd.Series) -> pd.DataFrame:
    """A model's label of a picture: a JSON object, perhaps fenced or inside other text; fields of a wrong type are empty."""

    def one(answer: str | None) -> tuple:
        found = regex.search(r"\{.*\}", answer or "", regex.DOTALL)
        try:
            fields = json.loads(found[0]) if found else {}
        except ValueError:
            fields = {}
        texts = lambda x: [t.strip() for t in x if isinstance(t, str) and t.strip()] if isinstance(x, list) else []
        caption = fields.get("caption") if isinstance(fields.get("caption"), str) else ""
        return caption.strip(), texts(fields.get("keywords")), texts(fields.get("emoji"))

    return pd.DataFrame([one(a) for a in answers], columns=["caption", "keywords", "glyphs"])


def looked_up(key: Column, labels: dict[str, str]) -> Column:
    """A key's label, the key itself without one."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), key), key) if labels else key
