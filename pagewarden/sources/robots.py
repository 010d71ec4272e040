"""robots.txt: rows of rules, kept as the nodes of a prefix tree, and verdicts for URLs by joins with them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "host string, group_no int, agent string, is_allow boolean, pattern string, length int, crawl_delay double, sitemap string"


def parse_robots(text: str) -> list[dict]:
    """Rules of every agent, in groups; an agent without rules, and a sitemap, get a row without pattern.
    An empty Disallow allows all, with length 0."""
    out: list[dict] = []
    row = lambda **k: out.append(dict.fromkeys(("group_no", "agent", "is_allow", "pattern", "length", "crawl_delay", "sitemap")) | k)
    agents: list[str] = []
    group, open_ = -1, False
    for line in text.lstrip("﻿").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not open_:
                agents, group = [], group + 1
            agents.append(value.lower())
            open_ = True
            row(group_no=group, agent=value.lower())
        elif key == "sitemap" and value:
            row(sitemap=value)
        elif key in ("allow", "disallow") and agents:
            open_ = False
            pattern = value if value[:1] in ("", "/", "*") else f"/{value}"
            for a in agents:
                row(group_no=group, agent=a, is_allow=key == "allow" or not value, pattern=pattern, length=len(pattern.encode()))
        elif key == "crawl-delay" and agents:
            open_ = False
            if re.fullmatch(r"\d+(\.\d+)?", value):
                for a in agents:
                    row(group_no=group, agent=a, crawl_delay=float(value))
    return out


def robots_rules(files: DataFrame) -> DataFrame:
    """Rows of RULES from files(host, body)."""

    def run(frames):
        names = [c.split()[0] for c in RULES.split(", ")]
        for frame in frames:
            rows = [{"host": h, **r} for h, b in zip(frame["host"], frame["body"]) for r in parse_robots(b or "")]
            yield pd.DataFrame(rows, columns=names).astype({"group_no": "Int32", "length": "Int32", "is_allow": "boolean", "crawl_delay": "Float64"})

    return files.select("host", "body").mapInPandas(run, RULES)


#: Wildcard rules are found by so many first characters of their longest fixed piece.
GRAM = 4


def trie(rules: DataFrame) -> DataFrame:
    """host, group_no, is_allow, length, and how a rule is found and checked: a row a rule.

    A pattern is what stands before its first *, the prefix, and the pieces after it. Its node is the hash of the prefix
    and its length, so a path meets the rules on its own way down and no others. A wildcard rule with a long enough
    piece is found by the piece's first characters in place of the prefix, as many such rules begin alike."""
    own = rules.filter("pattern IS NOT NULL").select("host", "group_no", "is_allow", "pattern", "length").distinct()
    own = own.withColumn("anchored", F.col("pattern").endswith("$")).withColumn("parts", F.split(F.regexp_replace("pattern", "[$]$", ""), "[*]"))
    own = own.withColumn("prefix", F.element_at("parts", 1)).withColumn("wild", F.col("anchored") | (F.size("parts") > 1))
    after = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    longest = F.array_max(F.transform(after, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    own = own.withColumn("last", F.when(F.col("anchored") & (F.size("parts") > 1), F.element_at("parts", -1)))
    own = own.withColumn("middle", F.filter(F.when(F.col("last").isNotNull(), F.slice(after, 1, F.size(after) - 1)).otherwise(after), lambda p: p != ""))
    own = own.withColumn("gram", F.when(longest["n"] >= GRAM, F.substring(longest["p"], 1, GRAM)))
    node = F.when(F.col("gram").isNull(), F.xxhash64(F.length("prefix"), "prefix")).otherwise(F.xxhash64(F.lit(-1), "gram"))
    return own.withColumn("node", node).withColumn("depth", F.when(F.col("gram").isNull(), F.length("prefix"))).drop("pattern", "parts", "gram")


def matched(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """host, group_no, path, length, allow: the rules' longest pattern that matches each of paths(host, group_no, path); of equal ones, one that allows.

    A path is looked up at the depths its group has, and by its pieces if the group has rules found so;
    what is found is compared without regular expressions, pieces from left to right."""
    nodes = trie(rules)
    depths = nodes.groupBy("host", "group_no").agg(F.collect_set("depth").alias("depths"), F.max(F.col("depth").isNull()).alias("pieces"))
    down = F.expr("transform(filter(depths, d -> d <= length(path)), d -> xxhash64(d, substring(path, 1, d)))")
    across = F.expr(f"CASE WHEN pieces AND length(path) >= {GRAM} THEN array_distinct(transform(sequence(1, length(path) - {GRAM - 1}), i -> xxhash64(-1, substring(path, i, {GRAM})))) ELSE array() END")
    probes = paths.join(depths, ["host", "group_no"]).select("host", "group_no", "path", F.explode(F.concat(down, across)).alias("node"))
    met = probes.join(nodes, ["host", "group_no", "node"]).filter("startswith(path, prefix)")
    # where the next piece may begin, 0 if one is missing
    end = F.expr("aggregate(middle, length(prefix) + 1, (at, p) -> CASE WHEN at = 0 OR locate(p, path, at) = 0 THEN 0 ELSE locate(p, path, at) + length(p) END)")
    whole = F.expr("CASE WHEN NOT wild THEN true WHEN end = 0 THEN false WHEN last IS NOT NULL THEN endswith(path, last) AND length(path) - length(last) + 1 >= end WHEN anchored THEN path = prefix ELSE true END")
    met = met.withColumn("end", F.when(F.col("wild"), end)).filter(whole)
    won = F.max(F.struct("length", F.col("is_allow").cast("int").alias("allow")))
    return met.groupBy("host", "group_no", "path").agg(won.alias("w")).select("host", "group_no", "path", "w.length", "w.allow")


def agent_group(rules: DataFrame, agents: DataFrame) -> DataFrame:
    """host, agent, group_no: the first named group of which either name holds the other, else the first of *.
    agents(agent) is a handful of bots."""
    groups = rules.filter("agent IS NOT NULL").select("host", "group_no", F.col("agent").alias("named")).distinct()
    # Agents are few and given by the caller, so each host's groups meet them without an exchange.
    met = groups.crossJoin(F.broadcast(agents.select("agent").distinct()))
    fits = F.expr("named = '*' OR (named <> '' AND (contains(lower(agent), named) OR contains(named, lower(agent))))")
    best = F.min(F.struct((F.col("named") == "*").cast("int").alias("star"), "group_no"))
    return met.filter(fits).groupBy("host", "agent").agg(best.alias("b")).select("host", "agent", F.col("b.group_no").alias("group_no"))


def verdicts(rules: DataFrame, urls: DataFrame, agents: DataFrame) -> DataFrame:
    """host, path, agent, allowed for urls(host, path): the longest pattern that matches wins, allow wins ties.

    Agents of one group share its verdicts."""
    paths, chosen = urls.select("host", "path").distinct(), agent_group(rules, agents)
    asked = paths.join(chosen.select("host", "group_no").distinct(), "host")
    found = matched(asked, rules).select("host", "group_no", "path", "allow")
    every = paths.crossJoin(F.broadcast(agents.select("agent").distinct())).join(chosen, ["host", "agent"], "left")
    return every.join(found, ["host", "group_no", "path"], "left").select("host", "path", "agent", F.coalesce(F.col("allow") == 1, F.lit(True)).alias("allowed"))


# Bots of AI search and of AI training.
RETRIEVAL_BOTS = ["OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "Claude-User", "Google-Extended"]
TRAINING_BOTS = ["GPTBot", "ClaudeBot", "CCBot", "Bytespider", "Meta-ExternalAgent", "Amazonbot", "Applebot-Extended"]
SITE_RULE_BOTS = ["GPTBot", "ClaudeBot", "PerplexityBot", "CCBot", "OAI-SearchBot"]


def ai_readiness(rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, retrieval and training (bot to ALLOWED or BLOCKED), has_llms_txt, risk, from hosts(host, has_llms_txt)."""
    spark = hosts.sparkSession
    bots = spark.createDataFrame([(b,) for b in RETRIEVAL_BOTS + TRAINING_BOTS], "agent string")
    seen = verdicts(rules, hosts.select("host", F.lit("/").alias("path")), bots)
    says = F.when(F.col("allowed"), "ALLOWED").otherwise("BLOCKED")
    of = lambda names: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("agent").isin(names), F.struct("agent", says)))))
    blocked = F.max((~F.col("allowed") & F.col("agent").isin("PerplexityBot", "OAI-SearchBot")).cast("int"))
    out = seen.groupBy("host").agg(of(RETRIEVAL_BOTS).alias("retrieval"), of(TRAINING_BOTS).alias("training"), blocked.alias("b")).join(hosts.select("host", "has_llms_txt"), "host")
    return out.withColumn("risk", F.when(F.col("b") == 1, "HIGH").when(~F.col("has_llms_txt"), "MEDIUM").otherwise("LOW")).drop("b")


def site_findings(rules: DataFrame, site_files: DataFrame) -> DataFrame:
    """host, code: site-level findings from site_files(host, robots_status, llms_status); a null robots_status
    is a fetch that failed, which leaves llms.txt unjudged."""
    bots = site_files.sparkSession.createDataFrame([(b,) for b in SITE_RULE_BOTS], "agent string")
    asked = site_files.filter("robots_status = 200").select("host", F.lit("/").alias("path"))
    bots_out = verdicts(rules, asked, bots).filter("NOT allowed").select("host").distinct().select("host", F.lit("ALERT_AI_SEARCH_BOTS_BLOCKED").alias("code"))
    down = site_files.filter("robots_status BETWEEN 500 AND 599").select("host", F.lit("ERR_HTTP_5XX_SERVER_ERROR").alias("code"))
    llms = site_files.filter("robots_status IS NOT NULL AND coalesce(llms_status, 0) <> 200").select("host", F.lit("WARN_LLMS_TXT_MISSING").alias("code"))
    return bots_out.unionByName(down).unionByName(llms)
