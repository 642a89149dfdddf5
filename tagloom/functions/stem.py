"""English stemming (the Snowball "english" / Porter2 algorithm, as published) for the search index, as a chain of
projections: every step is a regular expression over the word's ending and a comparison with its regions R1 and R2, so
the work stays in the JVM. It runs on the *distinct term dictionary* (joined back), never per token occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values of the algorithm ---------------------------------------------------------------
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
R1_PREFIXES = ("gener", "commun", "arsen")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
AFTER_STEP1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
         "iti", "ous", "ive", "ize", "ion")
# ------------------------------------------------------------------------------------------------


_VC = "^.*?[aeiouy][^aeiouy]"                  # up to the first consonant behind a vowel
_SHORT_END = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"


def _ending(w: Column, endings) -> Column:
    """The longest of the endings that the word has; empty if none."""
    longest_first = sorted(endings, key=len, reverse=True)
    return F.regexp_extract(w, f"({'|'.join(longest_first)})$", 1)


def _cut(w: Column, n) -> Column:
    """The word without its last ``n`` characters."""
    return F.substring(w, F.lit(1), F.length(w) - n)


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def stem_terms(terms: DataFrame, term_col: str = "term", out_col: str = "stem") -> DataFrame:
    """``terms`` with the stem of every term (lower-case words; a null stays null)."""
    w, e = F.col("_w"), F.col("_e")
    stem_length = F.length(w) - F.length(e)             # where the ending begins
    in_r1, in_r2 = (e != "") & (stem_length >= F.col("_r1")), (e != "") & (stem_length >= F.col("_r2"))
    d = terms.withColumn("_w", F.regexp_replace(F.regexp_replace(F.col(term_col), "^'", ""), "^y|(?<=[aeiouy])y", "Y"))
    prefix = F.length(F.regexp_extract(w, f"^({'|'.join(R1_PREFIXES)})", 0))
    first = F.length(F.regexp_extract(w, _VC, 0))
    d = d.withColumn("_r1", F.when(prefix > 0, prefix).when(first > 0, first).otherwise(F.length(w)))
    second = F.length(F.regexp_extract(F.substring(w, F.col("_r1") + 1, F.length(w)), _VC, 0))
    d = d.withColumn("_r2", F.when(second > 0, F.col("_r1") + second).otherwise(F.length(w)))

    def step(ending: Column | None, rule: Column) -> None:
        nonlocal d
        if ending is not None:
            d = d.withColumn("_e", ending)
        d = d.withColumn("_w", rule)

    # possessives, plurals
    step(_ending(w, ("'s'", "'s", "'")), _cut(w, F.length(e)))
    step(_ending(w, ("sses", "ied", "ies", "us", "ss", "s")),
         F.when(e == "sses", _cut(w, 2))
         .when(e.isin("ied", "ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
         .when((e == "s") & _cut(w, 2).rlike("[aeiouy]"), _cut(w, 1)).otherwise(w))
    d = d.withColumn("_done", F.when(w.isin(list(AFTER_STEP1A)), w))
    # past and -ing forms
    d = d.withColumn("_e", _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))).withColumn("_b", _cut(w, F.length(e)))
    b = F.col("_b")
    mended = (F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike(f"({'|'.join(DOUBLES)})$"), _cut(b, 1))
              .when((F.col("_r1") >= F.length(b)) & b.rlike(_SHORT_END), F.concat(b, F.lit("e"))).otherwise(b))
    step(None, F.when(e.isin("eed", "eedly"), F.when(in_r1, F.concat(b, F.lit("ee"))).otherwise(w))
         .when((e != "") & b.rlike("[aeiouy]"), mended).otherwise(w))
    # a final y behind a consonant
    step(None, F.when(w.rlike("^..*[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    # derivational endings
    step(_ending(w, STEP2), F.when(~in_r1, w)
         .when(e == "ogi", F.when(w.rlike("logi$"), _cut(w, 1)).otherwise(w))
         .when(e == "li", F.when(w.rlike(f"[{LI_ENDINGS}]li$"), _cut(w, 2)).otherwise(w))
         .otherwise(F.concat(_cut(w, F.length(e)), _table(STEP2)[e])))
    step(_ending(w, STEP3), F.when(~in_r1 | ((e == "ative") & ~in_r2), w)
         .otherwise(F.concat(_cut(w, F.length(e)), _table(STEP3)[e])))
    step(_ending(w, STEP4), F.when(~in_r2 | ((e == "ion") & ~w.rlike("[st]ion$")), w).otherwise(_cut(w, F.length(e))))
    # a final e or l
    last = F.length(w) - 1
    silent = (last >= F.col("_r2")) | ((last >= F.col("_r1")) & ~_cut(w, 1).rlike(_SHORT_END))
    step(None, F.when(w.endswith("e"), F.when(silent, _cut(w, 1)).otherwise(w))
         .when(w.endswith("ll") & (last >= F.col("_r2")), _cut(w, 1)).otherwise(w))
    word = F.col(term_col)
    out = (F.when(word.isin(list(EXCEPTIONS)), _table(EXCEPTIONS)[word]).when(F.length(word) < 3, word)
           .otherwise(F.replace(F.coalesce("_done", "_w"), F.lit("Y"), F.lit("y"))))
    return d.withColumn(out_col, out).drop("_w", "_e", "_b", "_r1", "_r2", "_done")
