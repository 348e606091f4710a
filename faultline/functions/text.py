"""Column expressions over log text. All but the search for many fixed texts at once stay inside the JVM."""

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from faultline.functions.patterns import re2_form, required_text
from faultline.rules import shell

BLANKS = " \t\r\n\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, NULL without a match or with an empty capture."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def any_of(patterns: Iterable[str], ignore_case: bool = False) -> str:
    """One alternation, each branch closed off so that inline flags stay inside it.

    If all branches begin at the start of the text, it is asked for once and not by every branch at every place.
    """
    flag, patterns = "(?i)" if ignore_case else "", list(patterns)
    if len(patterns) > 1 and all(p.startswith("^") and not _branches(p) for p in patterns):
        return "^(?:" + "|".join(f"(?:{flag}{p[1:]})" for p in patterns) + ")"
    return "|".join(f"(?:{flag}{p})" for p in patterns)


def _branches(pattern: str) -> bool:
    """Whether a `|` may stand outside all brackets; true where that is not plain to see."""
    depth = 0
    for c in re.sub(r"\\.|\[\^?[^\[\]\\&]*\]", "", pattern):
        if c in "[]" or (c == "|" and depth == 0):
            return True
        depth += (c == "(") - (c == ")")
    return depth != 0


#: Up to so many fixed texts are searched for one by one; more of them by one automaton over Arrow batches.
FEW_TEXTS = 3
#: Groups a screen tells apart, a bit each.
SCREEN_GROUPS = 62


def _screened_texts(patterns: Iterable[str]) -> list[str] | None:
    """Fixed texts of which one is in every text that one of the patterns matches; None if that is not known."""
    texts = [required_text(p) for p in patterns]
    if any(t is None for t in texts):
        return None
    fixed = sorted({t for ts in texts for t in ts})
    # letters outside ASCII may change their length with their case, which the automaton does not follow
    return fixed if all(t.isascii() or not any(ch.isalpha() for ch in t if ch > "\x7f") for t in fixed) else None


def screens(c: Column, groups: Sequence[list[str] | None]) -> Column:
    """Bit i is set if a text of group i is in `c`, whatever its case, or if the group is None; null for null.

    Only a screen: an exact pattern follows. Lines reach the automaton of a group only if one of all texts is found.
    """
    if len(groups) > SCREEN_GROUPS:
        raise ValueError(f"more than {SCREEN_GROUPS} groups")
    always = sum(1 << i for i, g in enumerate(groups) if g is None)
    automaton = lambda texts: "(?i)" + "|".join(re.escape(t) for t in texts)
    single = [(i, automaton(g)) for i, g in enumerate(groups) if g]
    if not single:
        return F.when(c.isNotNull(), F.lit(always).cast("bigint"))
    whole = automaton(sorted({t for g in groups if g for t in g}))

    @F.arrow_udf("bigint")
    def bits(texts: pa.Array) -> pa.Array:
        hit = pc.match_substring_regex(texts, whole)
        picked = pc.fill_null(hit, False)
        if len(groups) == 1:  # the search for all texts has told
            return pa.array(picked.to_numpy(zero_copy_only=False).astype(np.int64), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))
        some = texts.filter(picked)
        found = np.full(len(some), always, np.int64)
        for i, pattern in single:
            found |= pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False).astype(np.int64) << i
        out = np.full(len(texts), always, np.int64)
        out[picked.to_numpy(zero_copy_only=False)] = found
        return pa.array(out, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return bits(c)


def maybe(c: Column, groups: Iterable[Iterable[str]]) -> Column:
    """Whether a fixed text of the patterns is there at all; true where they have none."""
    texts = _screened_texts(p for g in groups for p in g)
    return F.lit(True) if texts is None else screens(c, [texts]) != 0


def maybe_each(c: Column, groups: Sequence[Iterable[str]]) -> list[Column]:
    """For each group of patterns whether a fixed text of them is there at all, true where they have none; one search for all groups."""
    bits = screens(c, [_screened_texts(g) for g in groups])
    return [bits.bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(groups))]


def maybe_any(c: Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """Whether one of the patterns may be found: a fixed text of those that have one is there, or one of the others is found."""
    patterns = list(patterns)
    plain = [p for p in patterns if _screened_texts([p]) is None]
    screen = maybe(c, [[p for p in patterns if p not in plain]])
    return screen | c.rlike(any_of(plain, ignore_case)) if plain else screen


def found(c: Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """Whether one of the patterns is found: a search for their fixed texts first, then the patterns."""
    return found_each(c, [list(patterns)], ignore_case)[0]


#: The bit that is set for texts which are not plain: some patterns are then left to Java, and RE2 tells only where a fixed text of them is.
ODD = 62


def _pattern_bits(c: Column, exact: Sequence[tuple[str, bool] | None], texts: Sequence[list[str] | None]) -> Column:
    """Bit i is set if the RE2 text `exact[i]` is found; without one, and for odd texts where it holds for plain ones alone, if a
    text of `texts[i]` is there (always, without texts). Null for null."""
    automaton = lambda ts: "(?i)" + "|".join(re.escape(t) for t in ts)
    screen = [automaton(t) if t else None for t in texts]
    told = any(e and e[1] for e in exact)  # odd texts count
    # one search for all groups tells for most texts that there is nothing
    whole = "|".join(e[0] for e in exact) if all(exact) else automaton(sorted({t for ts in texts for t in ts})) if all(texts) else None

    @F.arrow_udf("bigint")
    def bits(column: pa.Array) -> pa.Array:
        of = lambda rows, pattern: pc.fill_null(pc.match_substring_regex(rows, pattern), False).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(column), bool)
        if told:
            plain = pc.and_not(pc.string_is_ascii(column), pc.match_substring(column, "\n"))
            odd = ~pc.fill_null(plain, True).to_numpy(zero_copy_only=False)
        picked = of(column, whole) | odd if whole else np.ones(len(column), bool)
        some, odd = column.filter(pa.array(picked)), odd[picked]
        rest = some.filter(pa.array(odd)) if odd.any() else None
        found = odd.astype(np.int64) << ODD
        for i, (form, fixed) in enumerate(zip(exact, screen)):
            hit = of(some, form[0] if form else fixed)
            if form and form[1] and rest is not None:
                hit = hit.copy()  # of an Arrow buffer, which is not written to
                hit[odd] = of(rest, fixed) if fixed else True
            found |= hit.astype(np.int64) << i
        out = np.zeros(len(column), np.int64)
        out[picked] = found
        return pa.array(out, pa.int64(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return bits(c)


def found_each(c: Column, groups: Sequence[Sequence[str]], ignore_case: bool = False) -> list[Column]:
    """For each group of patterns whether one of them is found; all groups are searched in one go over Arrow batches.

    RE2 decides where all patterns of a group can be written for it; else it screens for fixed texts and Java's pattern decides.
    If no group has more than a few fixed texts, all stay in the JVM.
    """
    texts = [_screened_texts(g) for g in groups]
    hits = [c.rlike(any_of(g, ignore_case)) for g in groups]
    out = list(hits)
    if len(groups) <= FEW_TEXTS and all(t and len(t) <= FEW_TEXTS for t in texts):
        for i, t in enumerate(texts):
            any_text = F.lower(c).contains(t[0])
            for more in t[1:]:
                any_text = any_text | F.lower(c).contains(more)
            out[i] = any_text & hits[i]
        return out
    forms = [[re2_form(p, ignore_case) for p in g] for g in groups]
    exact = [("|".join(p for p, _ in f), any(plain for _, plain in f)) if f and all(f) else None for f in forms]
    searched = [i for i, t in enumerate(texts) if t or exact[i]]
    for start in range(0, len(searched), SCREEN_GROUPS):
        part = searched[start : start + SCREEN_GROUPS]
        bits = _pattern_bits(c, [exact[i] for i in part], [texts[i] for i in part])
        for bit, i in enumerate(part):
            out[i] = bits.bitwiseAND(F.lit(1 << bit)) != 0
            if not exact[i]:
                out[i] = out[i] & hits[i]
            elif exact[i][1]:
                out[i] = out[i] & ((bits.bitwiseAND(F.lit(1 << ODD)) == 0) | hits[i])
    return out


def first_match(c: Column, rules: Iterable[tuple[str, object]], ignore_case: bool = False) -> Column:
    """Value of the first rule whose pattern is found, NULL if none is."""
    rules, out = list(rules), None
    for (_, value), hit in zip(rules, found_each(c, [[p] for p, _ in rules], ignore_case)):
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def best_weight(c: Column, rules: Iterable[tuple[str, int]], ignore_case: bool = False) -> Column:
    """Highest weight among the rules found, 0 if none is; the rules of one weight are tried together."""
    by_weight: dict[int, list[str]] = {}
    for pattern, weight in rules:
        by_weight.setdefault(weight, []).append(pattern)
    out, weights = None, sorted(by_weight, reverse=True)
    for weight, hit in zip(weights, found_each(c, [by_weight[w] for w in weights], ignore_case)):
        out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    return out.otherwise(F.lit(0))


def first_number(c: Column, patterns: Iterable[str]) -> Column:
    """Number captured by the first pattern that is found (case-insensitive)."""
    patterns = list(patterns)
    number = F.coalesce(*[F.expr("try_cast(NULL as bigint)")] + [
        extract(c, "(?i)" + p).try_cast("bigint") for p in patterns
    ])
    texts = _screened_texts(patterns)
    return number if texts is None else F.when(screens(c, [texts]) != 0, number)


def shell_command(line: Column) -> Column:
    """The command of a traced shell line, NULL for any other line."""
    return extract(strip(line), shell.TRACED_COMMAND)


def dollar_command(line: Column) -> Column:
    return extract(strip(line), shell.DOLLAR_COMMAND)


def continued_command(line: Column) -> Column:
    """A script line without a trace sign; counts only if its first word is a known command."""
    cmd = extract(strip(line), shell.CONTINUATION)
    word = F.lower(F.substring_index(F.regexp_extract(cmd, r"^(\S+)", 1), "/", -1))
    return F.when(word.isin(*shell.KNOWN_COMMANDS), cmd)


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")


def tool_name(command: Column) -> Column:
    """Base name of the first word that is no variable assignment, looking inside one pair of quotes."""
    c = strip(command)
    inner = (
        F.when(c.rlike("^\"[^\"]*\""), F.regexp_extract(c, "^\"([^\"]*)\"", 1))
        .when(c.rlike("^'[^']*'"), F.regexp_extract(c, "^'([^']*)'", 1))
        .otherwise(c)
    )
    parts = words(inner)
    real = F.get(F.filter(parts, lambda x: ~(x.contains("=") & ~x.startswith("-"))), F.lit(0))
    fallback = F.substring_index(F.get(parts, F.lit(0)), "=", 1)
    named = F.btrim(F.substring_index(real, "/", -1), F.lit("'\""))
    return F.when(command.isNull(), F.lit(None)).otherwise(
        F.coalesce(F.when(F.size(parts) == 0, F.lit("shell")), named, fallback)
    )


def method_key(name: Column) -> Column:
    """Method name as compared: lower case, single spaces, no call brackets."""
    flat = strip(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.regexp_replace(flat, r"\(\)$", "")


def severity(line: Column) -> Column:
    low = F.lower(line)
    return (
        F.when(low.rlike("fatal|critical|panic"), F.lit("CRITICAL"))
        .when(low.rlike("error|exception|failed"), F.lit("ERROR"))
        .when(low.contains("warn"), F.lit("WARNING"))
        .otherwise(F.lit("ERROR"))
    )


def keywords(c: Column, stop_words: Iterable[str]) -> Column:
    """Words of three characters or more that are no stop words, with repeats."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(
        F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), F.lit(1)),
        lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x),
    )
