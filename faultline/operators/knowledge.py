"""Tool knowledge: merging definitions, recognising tools and known errors in text, finding similar cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.functions import rule_index as RI, text as X
from faultline.functions.scan import by_key, counted_small, top_per
from faultline.session import checkpointed

# Words that say nothing about an error.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "to", "of", "and", "or", "in", "on", "at", "for", "with",
    "this", "that", "it", "not", "no", "yes", "true", "false",
)


# ---- merging ----------------------------------------------------------------------------------

def merge_tools(definitions: DataFrame) -> DataFrame:
    """One row per tool name. Lists are made distinct before they are gathered."""
    one = definitions.groupBy("name").agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("id"))).alias("description"),
        F.min_by("docs_url", F.when(F.coalesce("docs_url", F.lit("")) != "", F.col("id"))).alias("docs_url"),
        F.max_by("source_file", F.when(F.coalesce("source_file", F.lit("")) != "", F.col("id"))).alias("source_file"),
        F.min_by("category", "id").alias("category"), F.max("confidence").alias("confidence"), F.count("*").alias("merged"),
    )
    for col, out in (("command", "commands"), ("signature", "signatures"), ("alias", "aliases")):
        one = one.join(
            definitions.filter(F.col(col).isNotNull()).select("name", col).distinct().groupBy("name").agg(
                F.array_sort(F.collect_list(col)).alias(out)
            ),
            "name", "left",
        )
    empty = F.expr("cast(array() as array<string>)")
    return one.select("*").withColumns({c: F.coalesce(c, empty) for c in ("commands", "signatures", "aliases")})


def merge_errors(errors: DataFrame) -> DataFrame:
    """One row per tool and code; the oldest stays."""
    rest = [c for c in errors.columns if c not in ("tool", "code")]
    return errors.groupBy("tool", "code").agg(F.min_by(F.struct(*rest), "id").alias("r")).select("tool", "code", "r.*")


def kb_stats(tools: DataFrame, errors: DataFrame, docs: DataFrame) -> DataFrame:
    part = lambda df, kind, by: df.groupBy(F.lit(kind).alias("kind"), F.col(by).alias("category")).agg(F.count("*").alias("n"))
    return part(tools, "tools", "category").unionByName(part(errors, "errors", "category")).unionByName(part(docs, "docs", "source"))


def tools_with_error_count(tools: DataFrame, errors: DataFrame) -> DataFrame:
    n = errors.groupBy(F.col("tool").alias("name")).agg(F.count("*").alias("errors"))
    return tools.join(n, "name", "left").select("name", "category", F.coalesce("errors", F.lit(0).cast("bigint")).alias("errors"))


# ---- recognising ------------------------------------------------------------------------------

def _named(low: Column, line: Column, patterns: Column) -> Column:
    """Whether a pattern is in the text; `regex:` marks a regular expression."""
    regex = lambda p: p.startswith("regex:") & F.regexp_like(line, F.concat(F.lit("(?i)"), F.substr(p, F.lit(7))))
    return F.exists(patterns, lambda p: F.when(p.startswith("regex:"), regex(p)).otherwise(low.contains(F.lower(p))))


def tool_score(text: Column) -> Column:
    """0.95 for the name as a word, 0.9 for name, alias or command anywhere, 0.8 for a signature."""
    low, name = F.lower(text), F.lower("name")
    as_word = (F.length(name) >= 3) & low.contains(name) & F.regexp_like(
        low, F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])\Q"), name, F.lit(r"\E(?:$|[^\p{L}\p{N}_])"))
    )
    anywhere = low.contains(name) | F.exists("aliases", lambda a: low.contains(F.lower(a))) | _named(low, text, F.col("commands"))
    return F.when(as_word, 0.95).when(anywhere, 0.9).when(_named(low, text, F.col("signatures")), 0.8)


def tool_needles(tools: DataFrame) -> DataFrame:
    """`tools` with `needles`: the names and texts that tell a tool, and the fixed texts of its expressions."""
    entries = F.concat(F.array(F.lower("name")), "aliases", "commands", "signatures")
    one = tools.select("name", F.explode(entries).alias("e"))
    regex = F.col("e").startswith("regex:")
    fixed = RI.needles_of_regex(F.when(regex, F.substr("e", F.lit(7))))
    texts = F.when(~regex, F.array(F.lower("e"))).when(F.size(fixed) > 0, fixed).otherwise(F.array(F.lit(None).cast("string")))
    return tools.join(one.select("name", F.explode(texts).alias("n")).groupBy("name").agg(F.collect_list(F.coalesce("n", F.lit(""))).alias("needles")), "name")


def identify_tools(texts: DataFrame, tools: DataFrame, text: str = "text", at=()) -> DataFrame:
    """Tools named in distinct texts, with a score. `at` as in `rule_index.matched`."""
    kb = tool_needles(tools.select("name", "aliases", "commands", "signatures"))
    pairs = RI.matched(texts, text, kb, "name", F.col("needles"), tool_score(F.col(text)).isNotNull(), at)
    return pairs.withColumn("score", tool_score(F.col(text))).select(*texts.columns, F.col("name").alias("tool"), "score")


def identify_tools_long(texts: DataFrame, tools: DataFrame, key: str, text: str = "text", at=()) -> DataFrame:
    """Tools named anywhere in a long text, one row per text and tool."""
    return identify_tools(texts.select(*{key: 0, **dict.fromkeys(at)}, text), tools, text, at).groupBy(key, "tool").agg(F.max("score").alias("score"))


def match_errors(texts: DataFrame, errors: DataFrame, text: str = "text", at=()) -> DataFrame:
    """Known errors found in texts. The patterns are matched once each, then joined to their errors."""
    t = F.col(text)
    patterns = errors.select("pattern", "is_regex").distinct().withColumn("rule", F.struct("pattern", "is_regex"))
    fixed = RI.needles_of_regex(F.when(F.col("is_regex"), F.col("pattern")))
    patterns = patterns.withColumn("needles", F.when(F.col("is_regex"), fixed).otherwise(F.array(F.lower("pattern"))))
    hit = F.when(F.col("is_regex"), F.regexp_like(t, F.concat(F.lit("(?i)"), F.when(F.col("is_regex"), F.col("pattern")).otherwise("")))).otherwise(
        F.lower(t).contains(F.lower("pattern"))
    )
    found = RI.matched(texts, text, patterns, "rule", F.col("needles"), hit, at).drop("rule", "needles")
    rules = errors.select("pattern", "is_regex", "tool", "code", "category", "fix", "retriable", F.col("confidence").alias("base"))
    boost = F.when((F.col("code") != "") & F.lower(t).contains(F.lower("code")), 0.1).otherwise(0.0)
    return found.join(counted_small(rules), ["pattern", "is_regex"]).withColumn("confidence", F.round(F.least(F.col("base") + boost, F.lit(1.0)), 6)).drop("base", "is_regex")


def knowledge_for_logs(texts: DataFrame, tools: DataFrame, errors: DataFrame, key: str, text: str = "text", k: int = 3, at=()) -> DataFrame:
    """Up to k tools and k known errors for each long text. `at` as in `rule_index.matched`."""
    whole = texts.select(*{key: 0, **dict.fromkeys(at)}, text)
    found = identify_tools_long(whole, tools, key, text, at)
    best_tools = top_per(found, k, [F.col("score").desc(), F.col("tool")], [key]).select(
        key, F.lit("tool").alias("kind"), "rn", F.col("tool").alias("name"), F.col("score").alias("confidence")
    )
    known = match_errors(whole, errors, text, at)
    best_errors = top_per(known, k, [F.col("confidence").desc(), F.col("tool"), F.col("code")], [key]).select(
        key, F.lit("error").alias("kind"), "rn", F.concat_ws("/", "tool", "code").alias("name"), "confidence"
    )
    return best_tools.unionByName(best_errors)


# ---- similar cases ----------------------------------------------------------------------------

# Attributes of a case, those of a query, and what equality of the two adds to the score.
BOOSTS = (("error_category", "category", 0.3), ("failed_stage", "stage", 0.2), ("failed_method", "method", 0.2))
SLACK = 1e-6  # scores are rounded to six digits before they are compared
SEED_WORDS, SEED_CASES = 8, 16
DEEPER = 0.1
HOT_WORD = 4096


def token_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return (
        rows.select(key, F.explode(X.keywords(F.col(text), STOP_WORDS)).alias("token"))
        .groupBy(key, "token").agg(F.count("*").alias("n"))
    )


def _bags(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, token): a word's repeats are tokens of their own, so the overlap of two bags is that of two sets."""
    words = rows.select(key, X.keywords(F.col(text), STOP_WORDS).alias("w"))
    counts = words.select(key, F.size("w").alias("size"), F.explode("w").alias("token")).groupBy(key, "size", "token").agg(F.count("*").alias("n"))
    each = counts.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return each.select(key, "size", F.when(F.col("i") == 1, F.col("token")).otherwise(F.concat_ws(" ", "token", F.col("i").cast("string"))).alias("token"))


def _weight(mask: int) -> float:
    return sum(w for i, (_, _, w) in enumerate(BOOSTS) if mask >> i & 1)


def _attributes(mask: int, side: int) -> list[Column]:
    """The attributes a mask compares, null where one of them is missing."""
    return [F.col(b[side]) for i, b in enumerate(BOOSTS) if mask >> i & 1]


def _under(mask: int, side: int, token: str | None = "token") -> Column:
    """Hash of a token under a mask (without a token: of the attributes alone); rows that lack an attribute of the mask have none. Equal hashes of
    different tokens only add pairs, which are scored from their bags like all others."""
    parts = _attributes(mask, side)
    key = F.xxhash64(F.lit(mask), *([token] if token else []), *parts)
    present = F.lit(True)
    for c in parts:
        present = present & c.isNotNull()
    return F.when(present, key)


def _boost(case: str = "", query: str = "") -> Column:
    equal = lambda a, b, w: F.when(F.col(case + a) == F.col(query + b), w).otherwise(0.0)
    return sum((equal(a, b, w) for a, b, w in BOOSTS[1:]), equal(*BOOSTS[0]))


def _scored(pairs: DataFrame, asked: DataFrame, kept: DataFrame) -> DataFrame:
    """Score of (qid, cid) pairs from their whole bags; pairs without a common word go. Pairs are narrow and
    bags are not, so the number of partitions is set by hand: their size says nothing of the work."""
    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")
    both = dealt.join(by_key(asked), "qid").join(by_key(kept), "cid").withColumn("common", F.size(F.array_intersect("q_bag", "c_bag")))
    score = F.round(2.0 * F.col("common") / (F.col("q_size") + F.col("size")) + _boost(), 6)
    return both.select("qid", "cid", score.alias("score"), "common").filter("common > 0").drop("common")


def find_similar(queries: DataFrame, feedback: DataFrame, k: int = 3, cut=checkpointed) -> DataFrame:
    """The k most similar of all cases for each query text: Dice on words counted with repeats, plus a boost for
    each equal attribute; ties go to the larger id. A case without a common word is not similar. Ids are keys of both tables.

    Equal queries are asked once, and of equal cases only the k largest ids can win. A few cases that share
    a rare word give each query a score its k-th best reaches at least. From it follows, for every set of
    equal attributes, the least Dice that still matters, hence how many of the query's words, rarest first,
    must contain a common one (prefix filter), which sizes a case may have (length filter) and how many of
    the words asked must be met. These words meet the cases by equality, with the attributes in the key;
    words of many cases are dealt over salts. Survivors are scored from their whole bags. No case is left out, so the result is that
    of all pairs.

    Null or empty texts, and texts of stop words alone, are similar to nothing. `cut` stores the tables that several branches read.
    """
    ask = ["text", *[b[1] for b in BOOSTS]]
    told = ["error_snippet", *[b[0] for b in BOOSTS]]
    asked = queries.select("query_id", *ask).filter("text is not null")
    distinct = asked.groupBy(*ask).agg(F.min("query_id").alias("qid"))
    members = cut(top_per(feedback.select("id", *told).filter("error_snippet is not null"), k, [F.col("id").desc()], told, "copy"))
    heads = members.filter("copy = 1").withColumnRenamed("id", "cid")

    case_tokens = cut(_bags(heads, "cid", "error_snippet").join(by_key(heads.drop("error_snippet", "copy")), "cid"))
    df = cut(case_tokens.groupBy("token").agg(F.count("*").alias("df")).withColumn("word", F.monotonically_increasing_id()))
    salts = F.ceil(F.col("df") / HOT_WORD)
    place = F.row_number().over(W.partitionBy("qid").orderBy("df", "token"))
    query_tokens = cut(
        _bags(distinct, "qid", "text").join(by_key(df), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("place", place).join(by_key(distinct.drop("text")), "qid")
    )
    bag = lambda t, key, out, rest: t.groupBy(key, "size", *rest).agg(F.collect_list("word").alias(out))
    q_bags = cut(bag(query_tokens, "qid", "q_bag", ask[1:]).withColumnRenamed("size", "q_size"))
    c_bags = cut(bag(case_tokens.join(by_key(df), "token"), "cid", "c_bag", told[1:]))

    masks = sorted(range(1 << len(BOOSTS)), key=_weight)
    keys = lambda side: F.explode(F.array_compact(F.array(*[_under(m, side) for m in masks]))).alias("key")
    index = cut(case_tokens.join(by_key(df), "token").select(
        "cid", "size", F.pmod(F.xxhash64("cid"), salts).alias("salt"), *[b[0] for b in BOOSTS], keys(0)
    ))

    # A few cases for every query: some that share its rarest words, under every mask, and some of equal attributes.
    rare = query_tokens.filter("df > 0").withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("place"))).filter(F.col("r") <= SEED_WORDS)
    alike = lambda side: F.explode(F.array_compact(F.array(*[_under(m, side, None) for m in masks[1:]]))).alias("key")
    few = lambda cases: top_per(cases, SEED_CASES, [F.col("cid").desc()], ["key"], "nth").drop("nth")
    by_word = rare.select("qid", keys(1)).join(by_key(few(index.select("key", "cid"))), "key")
    by_attributes = q_bags.select("qid", alike(1)).join(by_key(few(c_bags.select("cid", alike(0)))), "key")
    seeds = cut(_scored(by_word.unionByName(by_attributes).select("qid", "cid").distinct(), q_bags, c_bags))
    reached = top_per(seeds, k, [F.col("score").desc(), F.col("cid").desc()], ["qid"]).groupBy("qid").agg(
        F.when(F.count("*") == k, F.min("score") - SLACK).otherwise(F.lit(0.0)).alias("reach")
    )

    # The words that must hold a common one, by the equal attributes a pair would have.
    needed = query_tokens.withColumnRenamed("size", "q_size").join(by_key(reached), "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
    dice = lambda boost: F.greatest(F.col("reach") - boost, F.lit(0.0))

    def prefix(d: Column) -> Column:
        least = F.greatest(F.ceil(d * F.col("q_size") / (2.0 - d) - SLACK), F.lit(1))
        deeper = F.ceil(F.col("q_size") * DEEPER)  # more than must be asked, so that the hits say more
        return F.when(d <= 1.0, F.least(F.col("q_size") - least + 1 + deeper, F.col("q_size"))).otherwise(F.lit(0))

    # A mask asks for a place only where none of its parts does: they meet every case that it meets.
    asks = {m: F.col("place") <= prefix(dice(F.lit(_weight(m)))) for m in masks}
    alone = {}
    for m in masks:
        alone[m] = asks[m]
        for part in masks:
            if part != m and part & m == part:
                alone[m] = alone[m] & ~asks[part]
    wanted = F.array_compact(F.array(*[F.when(alone[m], _under(m, 1)) for m in masks]))
    probes = (
        needed.filter("df > 0").select("qid", "q_size", "reach", *[b[1] for b in BOOSTS], salts.alias("salts"), F.explode(wanted).alias("key"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    )
    d = dice(_boost())
    both = F.col("size") + F.col("q_size")
    hits = (
        probes.join(by_key(index), ["key", "salt"]).withColumn("d", d).filter((F.col("d") <= 1.0) & (2.0 * F.least("size", "q_size") >= (F.col("d") - SLACK) * both))
        .groupBy("qid", "cid", "size", "q_size", "d").agg(F.count("*").alias("hits"))
    )
    pairs = hits.filter(F.col("hits") + F.col("q_size") - prefix(F.col("d")) >= (F.col("d") - SLACK) / 2 * both).select("qid", "cid")
    best = top_per(_scored(pairs, q_bags, c_bags), k, [F.col("score").desc(), F.col("cid").desc()], ["qid"], "nth")

    # Back to all rows: the copies of the cases found, then the copies of the queries.
    same = lambda names, left, right: F.expr(" and ".join(f"{left}.{n} <=> {right}.{n}" for n in names))
    cases = members.alias("m").join(by_key(heads.alias("h")), same(told, "m", "h")).select("cid", "m.id")
    final = top_per(best.drop("nth").join(by_key(cases), "cid"), k, [F.col("score").desc(), F.col("id").desc()], ["qid"])
    copies = asked.alias("a").join(by_key(distinct.alias("d")), same(ask, "a", "d")).select("qid", "a.query_id")
    return final.join(by_key(copies), "qid").select("query_id", "rn", "id", "score")


#: Words of more source commands of a tool than this are usual.
USUAL_WORD = 64


def trace_to_source(steps: DataFrame, source_commands: DataFrame, least: float = 0.3, cut=checkpointed) -> DataFrame:
    """Source line whose command is most like a step's command: same tool, shared words over all words.

    Steps repeat the same commands, so distinct commands are compared and the result joined back. Words that few source
    commands of a tool hold meet by equality, and such pairs are scored from all their words. Pairs that share usual words
    alone score the same wherever these words and the sizes are the same: such commands are one kind, kinds meet by word, and
    the first source command stands for its kind. A pair without a common word is never formed.
    """
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))
    no_vars = lambda c: F.filter(bag(c), lambda w: ~w.startswith("$"))
    place = ["path", "src_line", "src_command"]
    cmds = cut(steps.select("tool", "command").distinct())
    src = cut(source_commands.select("tool", F.col("command").alias("src_command"), "path", "src_line").distinct())
    spelled = lambda df, w, n: df.withColumn("_w", w).withColumn(n, F.size("_w")).withColumn("word", F.explode("_w")).drop("_w")
    cmd_words, src_words = spelled(cmds, bag(F.col("command")), "n1"), spelled(src, no_vars(F.col("src_command")), "n2")
    usual = cut(src_words.groupBy("tool", "word").agg(F.count("*").alias("df")).filter(F.col("df") > USUAL_WORD).drop("df"))
    score = lambda both: F.round(both / (F.col("n1") + F.col("n2") - both), 6)

    few = src_words.join(usual, ["tool", "word"], "left_anti")
    pairs = cmd_words.join(few, ["tool", "word"]).select("tool", "command", *place, "n1", "n2").distinct()
    by_word = pairs.withColumn("score", score(F.size(F.array_intersect(bag(F.col("command")), no_vars(F.col("src_command"))))))

    words_of = lambda df, keys, out: df.join(usual, ["tool", "word"]).groupBy("tool", *keys).agg(F.array_sort(F.collect_list("word")).alias(out))
    cmd_kinds = cut(words_of(cmd_words, ["command", "n1"], "asked"))
    src_kinds = words_of(src_words, [*place, "n2"], "held").groupBy("tool", "held", "n2").agg(F.min(F.struct(*place)).alias("first"))
    met = cmd_kinds.select("tool", "asked", "n1").distinct().withColumn("word", F.explode("asked")).join(
        src_kinds.withColumn("word", F.explode("held")), ["tool", "word"]
    ).drop("word").distinct()
    likely = met.withColumn("score", score(F.size(F.array_intersect("asked", "held")))).filter(F.col("score") > least)
    kind = top_per(likely, 1, [F.col("score").desc(), F.col("first")], ["tool", "asked", "n1"]).select("tool", "asked", "n1", "first", "score")
    by_kind = cmd_kinds.join(kind, ["tool", "asked", "n1"]).select("tool", "command", "first.*", "score")

    best = by_word.select(*by_kind.columns).unionByName(by_kind).filter(F.col("score") > least)
    order = [F.col("score").desc(), *[F.col(c) for c in place]]
    pick = top_per(best, 1, order, ["tool", "command"]).select("tool", "command", "path", "src_line", "score")
    return steps.join(pick, ["tool", "command"])
