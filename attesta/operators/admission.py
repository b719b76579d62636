"""Which URLs may be read: origins, allow-list, exclusions, robots rules, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import confidence as C
from attesta.functions import urls as U
from attesta.session import materialize


def with_origin(df: DataFrame, origins: DataFrame, url: str = "url") -> DataFrame:
    """Attach host, origin and owning site; an unknown host has a null site.

    `origins`: (site, origin), one row per site.
    """
    hosts = origins.select(F.col("site"), U.host_of(F.col("origin")).alias("host"))
    with_host = df.withColumn("host", U.host_of(F.col(url))).withColumn(
        "origin", U.origin_of(F.col(url)))
    return with_host.join(hosts, "host", "left")


def split_allowed(df: DataFrame, origins: DataFrame, url: str = "url"
                  ) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): only http(s) URLs on a known host are kept."""
    hosts = origins.select(U.host_of(F.col("origin")).alias("_host")).distinct()
    keyed = df.withColumn("_host", F.when(
        U.scheme_of(F.col(url)).isin("http", "https"), U.host_of(F.col(url))))
    return (keyed.join(hosts, "_host", "left_semi").drop("_host"),
            keyed.join(hosts, "_host", "left_anti").drop("_host"))


#: Characters of the fragments by which patterns with a wildcard host find their URLs.
FRAGMENT = 5


def _fragments(text: Column) -> Column:
    """All distinct fragments of a text; none of a shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - (FRAGMENT - 1))
    return F.when(F.length(text) >= FRAGMENT, F.array_distinct(F.transform(
        starts, lambda i: F.substring(text, i, FRAGMENT)))).otherwise(F.array().cast("array<string>"))


def _matches(url: Column, pattern: Column, start: Column, regex: Column) -> Column:
    """The plain start is compared first; a regular expression is compiled only after that."""
    return F.startswith(url, start) & F.regexp(url, regex)


def _first_by_fragment(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, hit): the first of the patterns that matches each URL.

    A pattern is looked up by the rarest of its literal fragments, counted over the URLs; one with
    a fragment that no URL holds matches none. `urls`: distinct url; `patterns`: ord, pattern,
    start, regex and their fragments, none of them empty.
    """
    spread = patterns.select("ord", "pattern", "start", "regex",
                             F.explode("fragments").alias("fragment"))
    held = urls.select("url", F.explode(_fragments(F.col("url"))).alias("fragment"))
    counted = (held.join(spread.select("fragment").distinct(), "fragment")
               .groupBy("fragment").agg(F.count(F.lit(1)).alias("n")))
    rarest = spread.join(counted, "fragment", "left").groupBy(
        "ord", "pattern", "start", "regex").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "fragment")).alias("_r"))
    keyed = materialize(rarest.filter(F.col("_r.n") > 0).select(
        "ord", "pattern", "start", "regex", "_r.fragment"), "exclusions")
    found = held.join(keyed, "fragment").filter(
        _matches(F.col("url"), F.col("pattern"), F.col("start"), F.col("regex")))
    return found.groupBy("url").agg(F.min(F.struct("ord", "pattern")).alias("hit"))


def match_excluded(df: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Name the first pattern, in order, that a URL matches; null when none does.

    `patterns`: (pattern, ord), any number of them. Patterns that spell out a whole host meet URLs
    through an equi-join on it, one array row per host, so no URL row is ever multiplied. Patterns
    with a wildcard in the host meet them by their rarest literal fragment. Only patterns without
    any literal run of `FRAGMENT` characters, which match nearly everything, are walked by every
    URL; they are known on the driver, and there are few of them or the list is a mistake.
    """
    prepared = patterns.select(
        "ord", "pattern", U.wildcard_regex(F.col("pattern"), F.lit(True)).alias("regex"),
        F.split("pattern", r"\*", 2)[0].alias("start"),
        F.regexp_extract("pattern", r"^https?://([^/*:@?#]+)/", 1).alias("_host"),
        F.array_distinct(F.flatten(F.transform(F.split("pattern", r"\*"), _fragments)))
        .alias("fragments"))

    def first_hit(candidates: Column) -> Column:
        hits = F.filter(candidates, lambda p: _matches(F.col(url), p["pattern"], p["start"],
                                                       p["regex"]))
        return F.array_min(F.transform(hits, lambda p: F.struct(p["ord"], p["pattern"])))

    entries = F.sort_array(F.collect_list(F.struct("ord", "regex", "pattern", "start")))
    by_host = (prepared.filter(F.col("_host") != "").groupBy("_host")
               .agg(entries.alias("_by_host")))
    anywhere = prepared.filter((F.col("_host") == "") & (F.size("fragments") > 0))
    by_fragment = _first_by_fragment(
        df.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct(), anywhere)
    short = (prepared.filter((F.col("_host") == "") & (F.size("fragments") == 0))
             .agg(entries.alias("_any")).select("_any").scalar())
    keyed = df.withColumn("_host", U.host_of(F.col(url))).withColumn("_any", short)
    hit = F.array_min(F.filter(
        F.array(first_hit(F.col("_by_host")), first_hit(F.col("_any")), F.col("_hit")),
        lambda h: h.isNotNull()))
    return (keyed.join(by_host, "_host", "left")
            .join(by_fragment.select(F.col("url").alias(url), F.col("hit").alias("_hit")), url, "left")
            .withColumn("excluded_by", hit["pattern"])
            .select(*df.columns, "excluded_by"))


_HTML = r"(?is)^\s*(<!doctype|<html)"


def robots_rules(bodies: DataFrame) -> DataFrame:
    """One row per (host, group, rule) from robots bodies (host, body).

    A body is one row until its lines are typed; groups are numbered within a body, so several
    bodies of one host keep their groups apart. HTML bodies are absent.
    Columns: host, group_no, agents, rule_no, kind (allow|disallow|null), path, crawl_delay,
    signal.
    """
    lines = F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(
        F.regexp_replace(x, "#.*$", "")))
    fields = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(
            F.lower(F.trim(F.split(x, ":", 2)[0])).alias("field"),
            F.trim(F.split(x, ":", 2)[1]).alias("value")))
    known = F.filter(fields, lambda f: f["field"].isin(
        "user-agent", "allow", "disallow", "crawl-delay", "content-signal"))
    # A group starts at a user-agent line that does not directly follow another one.
    starts = F.transform(known, lambda f, i: F.struct(
        f["field"].alias("field"), f["value"].alias("value"),
        ((f["field"] == "user-agent") & ((i == 0) | (
            F.get(known, i - 1)["field"] != "user-agent"))).cast("int").alias("start")))
    typed = (bodies.select("host", "body").distinct().filter(~F.regexp("body", F.lit(_HTML)))
             .select("host", F.md5("body").alias("_body"),
                     F.posexplode(starts).alias("line_no", "line"))
             .select("host", "_body", "line_no", "line.*"))
    # Robots bodies are small files; the window stays inside one body.
    in_body = Window.partitionBy("host", "_body").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    grouped = typed.withColumn("group_no", F.sum("start").over(in_body)).filter("group_no > 0")
    is_agent = F.col("field") == "user-agent"
    is_rule = F.col("field").isin("allow", "disallow") & ~(
        (F.col("field") == "disallow") & (F.col("value") == ""))
    number = F.when(F.regexp("value", F.lit(r"^[0-9.]+$")), F.col("value").try_cast("double"))
    return grouped.groupBy("host", "_body", "group_no").agg(
        F.sort_array(F.collect_set(F.when(is_agent, F.lower("value")))).alias("agents"),
        F.sort_array(F.collect_list(F.when(is_rule, F.struct(
            "line_no", F.col("field").alias("kind"), F.col("value").alias("path"))))
        ).alias("rules"),
        F.max_by(number, F.when((F.col("field") == "crawl-delay") & number.isNotNull(),
                                F.col("line_no"))).alias("crawl_delay"),
        F.max_by("value", F.when(F.col("field") == "content-signal", F.col("line_no"))
                 ).alias("signal"),
    ).select("host", "group_no", "agents",
             F.posexplode_outer("rules").alias("rule_no", "rule"), "crawl_delay", "signal"
             ).select("host", "group_no", "agents", "rule_no", "rule.kind", "rule.path",
                      "crawl_delay", "signal")


def robots_decisions(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url"
                     ) -> DataFrame:
    """Decide every URL: groups naming the agent merged, else the `*` groups; the longest
    matching rule wins and a tie goes to allow; no rule means allowed.

    All rules of a host arrive as one array (a robots file is size-bounded by its host), so
    the only join is host = host and URL rows are never multiplied.
    """
    token = agent.lower()
    named = F.exists("agents", lambda a: (a != "*") & F.startswith(F.lit(token), a))
    starred = F.array_contains("agents", "*")
    anchored = F.endswith(F.col("path"), F.lit("$"))
    body = F.when(anchored, F.expr("left(path, length(path) - 1)")).otherwise(F.col("path"))
    entry = F.when(F.coalesce(F.col("path"), F.lit("")) != "", F.struct(
        F.length("path").alias("size"), (F.col("kind") == "allow").alias("allow"),
        F.col("path"), U.wildcard_regex(body, anchored).alias("regex"),
        F.split(body, r"\*", 2)[0].alias("start"),
        (~anchored & ~F.contains("path", F.lit("*"))).alias("plain")))

    def of(flag: Column, name: str) -> list[Column]:
        return [
            F.collect_list(F.when(flag, entry)).alias(f"{name}_rules"),
            F.max(flag.cast("int")).alias(f"{name}_any"),
            F.max_by("crawl_delay", F.when(flag & F.col("crawl_delay").isNotNull(),
                                           F.col("group_no"))).alias(f"{name}_delay")]

    per_host = rules.groupBy("host").agg(*of(named, "named"), *of(starred, "star"))
    use_named = F.col("named_any") == 1
    chosen = per_host.select(
        "host",
        F.when(use_named, F.col("named_rules")).otherwise(F.col("star_rules")).alias("_rules"),
        F.when(use_named, F.col("named_delay")).otherwise(F.col("star_delay"))
        .alias("crawl_delay"))
    target = U.path_and_query(F.col(url))
    best = F.array_max(F.transform(
        # Most rules are plain prefixes; a regular expression is compiled only for the others.
        F.filter("_rules", lambda r: F.startswith(target, r["start"])
                 & (r["plain"] | F.regexp(target, r["regex"]))),
        lambda r: F.struct(r["size"], r["allow"], r["path"])))
    return (urls.withColumn("host", U.host_of(F.col(url))).join(chosen, "host", "left")
            .withColumn("_best", best)
            .withColumn("allowed", F.coalesce(F.col("_best.allow"), F.lit(True)))
            .withColumn("rule", F.col("_best.path")).drop("_rules", "_best"))


def signal_drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Hosts whose stored usage signal differs from the observed one, with the keys.

    Both sides: (host, signal MAP). A host without a stored signal is a baseline.
    """
    before = previous.filter(F.col("signal").isNotNull()).select(
        "host", F.col("signal").alias("before"))
    after = current.select("host", F.col("signal").alias("after"))
    empty = F.create_map().cast("map<string,string>")
    joined = before.join(after, "host", "left").withColumn("after", F.coalesce("after", empty))
    keys = F.sort_array(F.array_union(F.map_keys("before"), F.map_keys("after")))
    changed = F.filter(keys, lambda k: ~F.try_element_at("before", k).eqNullSafe(
        F.try_element_at("after", k)))
    return joined.withColumn("changed_keys", changed).filter(F.size("changed_keys") > 0)


def with_interval(sources: DataFrame) -> DataFrame:
    """Default recrawl interval, in hours, by the first entity type."""
    first = F.get("entity_types", F.lit(0))
    default = F.coalesce(C.policy(K.RECRAWL_HOURS, first), F.lit(K.DEFAULT_RECRAWL_HOURS))
    stated = F.col("recrawl_hours") if "recrawl_hours" in sources.columns else F.lit(None)
    return sources.withColumn("recrawl_hours", F.coalesce(stated, default).cast("int"))


def _since_and_allowed(now: Column) -> tuple[Column, Column]:
    since = F.timestamp_diff("HOUR", F.col("last_fetch_at"), now)
    return since, F.when(F.col("method") == "manual", F.lit(K.MANUAL_OVERDUE_DAYS * 24)).otherwise(
        F.col("recrawl_hours"))


def source_report(sources: DataFrame, now: Column) -> DataFrame:
    """Every source with its facts and the whole days it is overdue, 0 when it is not."""
    since, allowed = _since_and_allowed(now)
    return sources.withColumn("days_overdue", F.greatest(
        F.lit(0), F.floor((since - allowed) / 24)).cast("int"))


def overdue_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Sources past their interval, whole days overdue, and an alert at twice the interval.

    Manual sources are overdue 120 days after the last look.
    """
    since, allowed = _since_and_allowed(now)
    return (sources.withColumn("days_overdue", F.floor((since - allowed) / 24).cast("int"))
            .withColumn("alert", since >= 2 * allowed).filter(since > allowed))


#: Ranks up to here Spark cuts off in each task before the shuffle.
PRUNED_RANK = 1000


def _last_admitted(keyed: DataFrame, limit: int) -> DataFrame:
    """(_run, _last): the key of each run's last admitted row. `keyed`: _run, _key.

    A small limit is a rank that Spark prunes to `limit` rows per run and task. For a large one the
    narrow keys are sorted over the cluster, and counts per (run, range) tell in which range and
    at which offset the cut lies: no task ranks a whole run.
    """
    if limit <= PRUNED_RANK:
        place = F.row_number().over(Window.partitionBy("_run").orderBy("_key"))
        return (keyed.withColumn("_n", place).filter(F.col("_n") <= limit)
                .groupBy("_run").agg(F.max("_key").alias("_last")))
    placed = materialize(keyed.repartitionByRange("_run", "_key").sortWithinPartitions("_run", "_key")
                         .withColumn("_id", F.monotonically_increasing_id()), "budget")
    ranges = placed.groupBy("_run", F.shiftright("_id", 33).alias("_part")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_run").orderBy("_part")
    upto = F.sum("_size").over(before)
    whole = F.sum("_size").over(Window.partitionBy("_run"))
    cut = F.least(F.lit(limit), F.col("_whole"))
    ids = (ranges.withColumns({"_upto": upto, "_whole": whole})
           .filter((F.col("_upto") >= cut) & (F.col("_upto") - F.col("_size") < cut))
           .select((F.col("_first") + cut - (F.col("_upto") - F.col("_size")) - 1).alias("_id")))
    return placed.join(ids, "_id").select("_run", F.col("_key").alias("_last"))


def apply_budget(df: DataFrame, order: Sequence[str], run: str = "run_id",
                 limit: int = K.PAGE_BUDGET) -> DataFrame:
    """Keep the first `limit` URLs of each run in `order`; mark the rest failed.

    `order` must be unique within a run; rows without a run are one run. Only each run's last
    admitted key is looked for; the other rows meet that key in a join.
    """
    key = F.struct(*order)
    last = _last_admitted(df.select(F.col(run).alias("_run"), key.alias("_key")), limit)
    admitted = key <= F.col("_last")
    return (df.join(last, F.col(run).eqNullSafe(F.col("_run")))
            .withColumn("admitted", admitted)
            .withColumn("error", F.when(~admitted, F.lit(f"maxPagesPerRun ({limit}) reached")))
            .drop("_last", "_run"))


def fetch_outcomes(attempts: DataFrame, key: str = "url") -> DataFrame:
    """One outcome per URL from an attempt log (url, attempt, status).

    The last attempt decides. 304 is unchanged, 400 and above failed (a null status is a
    transport error), else fetched; only 5xx, 429 and transport errors are retryable.
    """
    last = attempts.groupBy(key).agg(F.max(F.struct("attempt", "status")).alias("_last"))
    status = F.col("_last.status")
    return last.select(
        key, F.col("_last.attempt").alias("attempts"), status.alias("status"),
        F.when(status == 304, "unchanged").when(status.isNull() | (status >= 400), "failed")
        .otherwise("fetched").alias("outcome"),
        (status.isNull() | (status >= 500) | (status == 429)).alias("retryable"))


_SUSPENDED_URL = r"(?i)/cgi-sys/suspendedpage\.cgi|suspended"
_DEAD_BODY = r"(?i)suspended|coming soon|under construction|parked"


def probe_status(probes: DataFrame, min_bytes: int = K.LIVE_MIN_BYTES) -> DataFrame:
    """Liveness judged from content: (status, final_url, body) to active, suspended or
    unavailable, with a note saying which test failed."""
    bad_url = F.regexp("final_url", F.lit(_SUSPENDED_URL))
    bad_body = F.regexp("body", F.lit(_DEAD_BODY))
    small = F.octet_length("body") <= min_bytes
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    note = (F.when(~ok, F.concat(F.lit("http "), F.coalesce(F.col("status").cast("string"),
                                                            F.lit("none"))))
            .when(bad_url, "suspension url").when(bad_body, "suspension text")
            .when(small, "body too small"))
    return probes.withColumn("probe_note", note).withColumn(
        "source_status", F.when(~ok, "unavailable").when(bad_url | bad_body, "suspended")
        .when(small, "unavailable").otherwise("active"))
