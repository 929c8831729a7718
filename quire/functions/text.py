"""Text predicates and rewrites, as Column functions.

Regexes are Java's. Where a rule rewrites only some of a pattern's matches, the text is cut at marks
around the matches and each odd part is judged by itself (rewrite_matches).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REACTION = ("->", "→", "⇌", "<=>")
OPERATORS = ("=", "^", "√", "∫", "Σ", "/", "±")
PROSE_HINTS = ("다음", "서술", "설명", "물음", "이유", "자료", "그림", "조건", "과정", "답", "쓰시오", "표시", "계산", "경향성", "존재")
PLAIN, RAISED, LOWERED = "0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "₀₁₂₃₄₅₆₇₈₉"
ELEMENT, STATE = "[A-Z][a-z]?", r"\((?:aq|s|l|g)\)"
BODY = rf"(?:{ELEMENT}(?:\d+)?|\([A-Za-z0-9]+\)(?:\d+)?)+"
CHEM_TOKEN = (
    rf"([{RAISED[:10]}]*[{LOWERED}]*{ELEMENT}[{RAISED}]+"
    rf"|\[{BODY}\](?:\d*[+-]|[{RAISED}]+)?"
    rf"|{BODY}(?:\d*[+-])?(?:{STATE})?"
    r"|[A-Z][⁺⁻]?\(g\))"
)
CHEM_RUN = r"([\[\]A-Za-z0-9⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉()+\-→<>=,\.|*]+)"
CHART_LABELS = ("(가)", "(나)", "(다)", "(라)", "Contour plots", "Line scan", "x", "y", "z", "A→", "B→", ">")
MARK = "\u0001"


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def collapse(s: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(s, r"(?U)\s+", " "))


def any_in(s: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(t) for t in tokens])


def count_of(s: Column, token: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))) / len(token)).cast("int")


def count_matching(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def has_upper(s: Column) -> Column:
    return s.rlike(r"\p{IsUppercase}")


def canonicalize(s: Column) -> Column:
    return F.regexp_replace(collapse(s), r"\d+", "#")


def _prose(t: Column) -> Column:
    letters, spaces = count_matching(t, r"\p{L}"), count_of(t, " ")
    sentence = (spaces >= 2) & (letters >= F.greatest(F.lit(10), (F.length(t) * F.lit(0.35)).cast("int")))
    return (t != "") & ~any_in(t, REACTION) & ~any_in(t, OPERATORS) & (sentence | (any_in(t, PROSE_HINTS) & (spaces >= 1)))


def is_prose(s: Column) -> Column:
    return let(collapse(s), _prose)


def is_equation(s: Column) -> Column:
    def test(t: Column) -> Column:
        operators = reduce(lambda a, b: a + b, [count_of(t, o) for o in OPERATORS])
        symbols, digits, letters = (count_matching(t, p) for p in (r"[=^√∫Σ/±()\[\]{}]", r"\p{Nd}", r"\p{L}"))
        formula = (operators >= 1) & (F.length(t) < 180) & (symbols + digits >= F.greatest(F.lit(3), F.floor(letters / 2)))
        plain = t.rlike(r"^[A-Za-z0-9\[\]()+\-.\s]+$") & (digits >= 2) & (count_of(t, "+") + count_of(t, "-") >= 2)
        return F.when((t == "") | _prose(t), False).when(any_in(t, REACTION), has_upper(t)).otherwise(formula | plain)

    return let(collapse(s), test)


def rewrite_matches(s: Column, pattern: str, f) -> Column:
    """Each match of `pattern` (one group around all of it) replaced by f(match); the rest stays."""
    parts = F.split(F.regexp_replace(F.replace(s, F.lit(MARK), F.lit("")), pattern, f"{MARK}$1{MARK}"), MARK, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, f(x)).otherwise(x)), "")


def superscript(s: Column) -> Column:
    return F.translate(s, PLAIN, RAISED)


# --- repairs: the patterns and replacements from here to is_chart_label() are fixed values -----------


def repair_ionic(s: Column) -> Column:
    return F.regexp_replace(s, r"\blonic\b", "Ionic")


def repair_alpha(s: Column) -> Column:
    return F.regexp_replace(s, r"(?<![A-Za-z])a(?=\s+particles\b)", "α")


def repair_angstrom(s: Column) -> Column:
    s = F.regexp_replace(s, r"(\d+(?:\.\d+)?)\s+8(?=일 때|에서|이고|이면|인|를|을|,|\)|$)", "$1Å")
    return F.regexp_replace(s, r"(\d+\.\d+)\s+A(?=\s|$|\))", "$1Å")


def repair_isotope(s: Column) -> Column:
    s = F.replace(s, F.lit("(He2+)"), F.lit("(⁴₂He²⁺)"))
    s = F.regexp_replace(s, r"(?<!\d)4He2\+", "⁴₂He²⁺")
    whole = rf"(\b\d{{1,3}}\s*{ELEMENT}\s*\d{{1,2}}\s*\+\s*)"

    def raised(m: Column) -> Column:
        part = rf"^(\d{{1,3}})\s*({ELEMENT})\s*(\d{{1,2}})\s*\+\s*$"
        return F.concat(superscript(F.regexp_extract(m, part, 1)), F.regexp_extract(m, part, 2), superscript(F.concat(F.regexp_extract(m, part, 3), F.lit("+"))))

    return rewrite_matches(s, whole, raised)


def repair_ions(s: Column) -> Column:
    s = F.regexp_replace(s, r"\b([A-Z])\s*\+\s*([A-Z])\s*\(g\)", "$1⁺$2⁻(g)")
    s = F.regexp_replace(s, r"\b([A-Z])\s*\+\s*\(g\)", "$1⁺(g)")
    return F.regexp_replace(s, r"\b([A-Z])\s*\(g\)(?=\s*[가을를로의])", "$1⁻(g)")


def is_chem_like(token: Column) -> Column:
    return (token.contains("[") | token.rlike(r"\p{Nd}")) & has_upper(token)


def norm_chem_token(token: Column) -> Column:
    t = F.translate(F.regexp_replace(token, r"\s+", ""), "|*", "l+")
    for pattern, to in ((r"(?<=H)0(?=[(\d\]])", "O"), (r"(?<=\d)0(?=[A-Z])", "O"), (r"\([1I]\)", "(l)"), (r"\([aAqQ]\)", "(aq)"), (r",(?=\d)", ".")):
        t = F.regexp_replace(t, pattern, to)
    return t


def repair_chem_tokens(s: Column) -> Column:
    return rewrite_matches(s, CHEM_RUN, lambda t: F.when(is_chem_like(t), norm_chem_token(t)).otherwise(t))


def repair_scientific(s: Column) -> Column:
    """All repairs, in their order."""
    for step in (repair_ionic, repair_alpha, repair_angstrom, repair_isotope, repair_ions, repair_chem_tokens):
        s = step(s)
    return s


def unicode_chem(token: Column) -> Column:
    """Script of an isotope or ion written with raised and lowered digits; null for others."""
    down = lambda c: F.translate(c, RAISED + LOWERED, PLAIN + PLAIN[:10])
    isotope = rf"^([{RAISED[:10]}]+)([{LOWERED}]*)({ELEMENT})([{RAISED}]+)$"
    ion = rf"^({ELEMENT})([{RAISED}]+)\(g\)$"
    group = lambda p, i: F.regexp_extract(token, p, i)
    atomic = F.when(group(isotope, 2) == "", "").otherwise(F.concat(F.lit("_{"), down(group(isotope, 2)), F.lit("}")))
    script = F.concat(F.lit(" ^{"), down(group(isotope, 1)), F.lit("}"), atomic, group(isotope, 3), F.lit("^{"), down(group(isotope, 4)), F.lit("} "))
    return F.when(token.rlike(isotope), script).when(token.rlike(ion), F.concat(group(ion, 1), F.lit("^{"), down(group(ion, 2)), F.lit("}(g)")))


def ascii_chem(token: Column) -> Column:
    """Digits lowered, charge raised, state kept; null without a capital and for capitals alone."""
    state = F.regexp_extract(token, rf"({STATE})$", 1)
    rest = F.regexp_replace(token, rf"{STATE}$", "")
    charge = F.regexp_extract(rest, r"(\d*[+-])$", 1)
    rest = F.regexp_replace(rest, r"\d*[+-]$", "")
    raised = F.when(charge == "", "").otherwise(F.concat(F.lit("^{"), charge, F.lit("}")))
    script = F.concat(F.regexp_replace(rest, r"(\d+)", r"_{$1}"), raised, state)
    return F.when(rest.rlike("[A-Z]") & ~rest.rlike("^[A-Z]{2,}$"), script)


def chem_script(token: Column) -> Column:
    fixed = F.when(token == "A⁺B⁻(g)", "A^{+}B^{-}(g)").when(token == "A⁺(g)", "A^{+}(g)").when(token == "B⁻(g)", "B^{-}(g)")
    return F.coalesce(fixed, unicode_chem(token), ascii_chem(token))


def chem_segments(s: Column) -> Column:
    """array<struct<type,text,script>>: text and equation parts in order; tokens without a script are text."""
    clean = F.replace(s, F.lit(MARK), F.lit(""))
    # Tokens without a script are told apart first, so that their text stays in one piece with its neighbours.
    marked = rewrite_matches(clean, CHEM_TOKEN, lambda t: F.when(chem_script(t).isNull(), t).otherwise(F.concat(F.lit("\u0002"), t, F.lit("\u0002"))))
    parts = F.split(marked, "\u0002", -1)
    none = F.lit(None).cast("string")
    typed = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.struct(F.lit("equation").alias("type"), none.alias("text"), chem_script(x).alias("script"))).otherwise(F.struct(F.lit("text").alias("type"), x.alias("text"), none.alias("script"))))
    full = F.filter(typed, lambda p: (p["type"] == "equation") | (p["text"] != ""))
    whole = F.array(F.struct(F.lit("text").alias("type"), s.alias("text"), none.alias("script")))
    return F.when(F.size(full) > 0, full).otherwise(whole)


def inlines_equation(s: Column) -> Column:
    return let(collapse(s), lambda t: any_in(t, REACTION) & (count_matching(t, "[가-힣]") >= 4) & (count_of(t, " ") >= 2))


def norm_formula(s: Column) -> Column:
    """struct<text,valid>"""
    text = F.regexp_replace(F.replace(F.replace(strip(s), F.lit("**"), F.lit("^")), F.lit("sqrt"), F.lit("√")), r"(?U)\s+", " ")
    return let(text, lambda t: F.struct(t.alias("text"), any_in(t, ("=", "^", "/", "√", "→", "->", "⇌", "+", "-")).alias("valid")))


def norm_chem_equation(s: Column) -> Column:
    text = F.regexp_replace(F.replace(F.replace(strip(s), F.lit("→"), F.lit("->")), F.lit("⇌"), F.lit("<=>")), r"(?U)\s+", " ")
    return let(text, lambda t: F.struct(t.alias("text"), (any_in(t, ("->", "<=>")) & t.rlike("[A-Z]")).alias("valid")))


def is_chart_label(s: Column) -> Column:
    t = collapse(s)
    short = (F.length(t) <= 14) & t.rlike(r"^[\dA-Za-z가-힣+\-().,/→§ ]+$") & (F.size(F.split(t, " ")) <= 3)
    return (t != "") & (short | t.rlike(r"^[+\-]?\d+(?:\.\d+)?(?:\s+[+\-]?\d+(?:\.\d+)?)*$") | t.isin(*CHART_LABELS))


def strip_note_lead(s: Column, number: Column) -> Column:
    """The prefixes `N. `, `N.`, `N) ` and `N)` taken off one after the other."""
    for tail in (". ", ".", ") ", ")"):
        lead = F.concat(number.cast("string"), F.lit(tail))
        s = F.when(F.startswith(s, lead), F.substring(s, F.length(lead) + 1, F.length(s))).otherwise(s)
    return strip(s)


def filename_tokens(stem: Column) -> Column:
    return F.filter(F.split(stem, "[-_]"), lambda x: x != "")
