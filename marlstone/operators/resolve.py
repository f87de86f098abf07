"""Entity resolution: candidates against known companies by token, host, normalized name and trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import expr as X
from marlstone.operators.alike import alike
from marlstone.operators.latest import latest_per_key
from marlstone.operators.lineage import cut
from marlstone.operators.skew import hot_keys, salted_join
from marlstone.schemas import SOURCES

THRESHOLD, FUZZY_SHOWN, REVISIT_DAYS = 0.4, 3, 90
#: What one request may ask: candidates, and days that count as recent.
MOST_CANDIDATES, RECENT_DAYS, MOST_DAYS = 200, 30, 2**31 - 1
#: Pairs that a join on rare trigrams may meet one by one; beyond, and beyond one in a thousand of all pairs, names meet in blocks.
MOST_MET = 1_000_000
KINDS = {"token": 4, "domain": 3, "name_only": 2, "fuzzy_name": 1}


def recent_companies(companies: DataFrame, snapshots: DataFrame, as_of: Column, days: int = RECENT_DAYS) -> DataFrame:
    """companies with has_recent_snapshot: any fetched within the days before as_of, the edge included."""
    recent = snapshots.where(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(days))).groupBy("company_id").agg(F.lit(True).alias("_recent"))
    out = companies.join(recent, companies["id"] == recent["company_id"], "left").drop("company_id")
    return out.withColumn("has_recent_snapshot", F.coalesce("_recent", F.lit(False))).drop("_recent")


def name_matches(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """input_index, id of companies whose normalized name is the candidate's, all collisions."""
    c = companies.select(F.col("id"), X.normalize_name(F.col("name")).alias("_k"))
    return candidates.select("input_index", X.normalize_name(F.col("name")).alias("_k")).where("_k <> ''").join(c, "_k").select("input_index", "id")


def host_matches(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    c = companies.select("id", X.url_host(F.col("careers_page_url")).alias("_h"))
    return candidates.select("input_index", X.url_host(F.col("careers_url")).alias("_h")).join(c, "_h").select("input_index", "id")


def _grams() -> Column:
    return X.trigram_codes(X.trigrams(F.col("name")))


def _gram_counts(known: DataFrame) -> DataFrame:
    return known.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def _fronts(sets: DataFrame, key: str, name: str, counts: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """(key, trigrams as ``name``, rarest first, front_name, at_name, g): a row for each trigram g of the front."""
    ranked = salted_join(sets.select(key, F.explode("grams").alias("g")), counts, "g", hot, [key], "left")
    ranked = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("o")).select(key, F.col("o.g").alias(name))
    keep = F.size(name) - F.ceil(F.size(name) * threshold - 1e-9).cast("int") + 1
    return ranked.withColumn(f"front_{name}", F.slice(name, 1, keep)).select("*", F.posexplode(f"front_{name}").alias(f"at_{name}", "g"))


def fuzzy_matches(candidates: DataFrame, companies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """input_index, id, score of names whose trigram similarity reaches the threshold.

    Exact without comparing all pairs: two sets of n and m trigrams that are that similar share more than any
    ``n - ceil(threshold * n)`` of the candidate's, so some trigram among its ``n - ceil(threshold * n) + 1`` rarest is
    common to both (and, with one order for all, among the company's rarest too). Only those meet in an equi-join.
    """
    sides = [df.select(key, _grams().alias("grams")).where(F.size("grams") > 0) for df, key in ((candidates, "input_index"), (companies, "id"))]
    counts = _gram_counts(sides[1])
    hot = hot_keys(counts, "g", "n", counts.agg(F.sum("n")).first()[0] or 0)
    prefixed = [_fronts(df, key, name, counts, hot, threshold) for df, key, name in zip(sides, ("input_index", "id"), "ab", strict=True)]
    n, m = F.size("a"), F.size("b")
    # what is common from here on must reach what the threshold asks of the union, if this is the first that they share
    room = F.least(n - F.col("at_a"), m - F.col("at_b")) * (1 + threshold) >= threshold * (n + m) - 1e-9
    # both fronts are in one order, so a pair is met once: at its first; the arrays go through one shuffle only
    first = F.get(F.array_intersect("front_a", "front_b"), F.lit(0)) == F.col("g")
    both = F.size(F.array_intersect("a", "b"))
    score = (both / (n + m - both)).cast("float").cast("double")
    met = salted_join(prefixed[1], prefixed[0], "g", hot, ["id"]).where(F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9).where(room).where(first)
    return met.withColumn("score", score).where(F.col("score") >= F.lit(threshold).cast("float").cast("double")).select("input_index", "id", "score")


def request_failures(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """request_id, path, code of look-ups (request_id, recency_days) over their candidates (request_id, ...) that ask too much."""
    n = candidates.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    days = F.coalesce(F.col("recency_days").cast("long"), F.lit(RECENT_DAYS))
    rules = (("candidates", "too_many_candidates", F.coalesce("_n", F.lit(0)) > MOST_CANDIDATES), ("recency_days", "invalid_recency_days", ~days.between(1, MOST_DAYS)))
    # the first that is wrong is told, as a request is refused by it
    found = F.coalesce(*(F.when(broken, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for path, code, broken in rules))
    return requests.join(n, "request_id", "left").select("request_id", found.alias("f")).where("f is not null").select("request_id", "f.*")


def _many_meet(asked: DataFrame, known: DataFrame, threshold: float) -> bool:
    """Whether fuzzy_matches() would join more pairs than it should: those at trigrams of the asked fronts, at most."""
    counts = cut(_gram_counts(known))
    hot = hot_keys(counts, "g", "n", counts.agg(F.sum("n")).first()[0] or 0)
    met = _fronts(asked, "input_index", "a", counts, hot, threshold).join(counts, "g").agg(F.sum("n")).first()[0] or 0
    return met > MOST_MET and met > asked.count() * known.count() // 1_000


def _alike_names(asked: DataFrame, known: DataFrame, shown: int) -> DataFrame:
    """input_index, match_count, top: the sum of n over the known names (id, name, n, grams) that are alike, and the ``shown`` most alike of them."""
    sets = [df.where(F.size("grams") > 0) for df in (asked, known)]
    if _many_meet(*sets, THRESHOLD):
        return alike(sets[0].select("input_index", "grams"), sets[1].select("id", "n", "grams"), THRESHOLD, shown)
    met = fuzzy_matches(asked, known).join(known.select("id", "n"), "id")
    here = F.struct("score", (-F.col("id")).alias("neg"))
    found = met.groupBy("input_index").agg(F.sum("n").alias("match_count"), F.array(F.max(here)).alias("top"))
    if shown == 1:
        return found
    top = _first(met, shown, "input_index", F.col("score").desc(), "id").groupBy("input_index").agg(F.sort_array(F.collect_list(here), False).alias("top"))
    return found.drop("top").join(top, "input_index")


def _first(df: DataFrame, n: int, key: str, *order: Column | str) -> DataFrame:
    """The first n rows of each key: a rank that is filtered at once is cut in each task before the shuffle, so no key's rows meet in one."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _fuzzy_by_name(candidates: DataFrame, companies: DataFrame, shown: int) -> DataFrame:
    """input_index, match_count, top: how many companies are alike each candidate by its name, and the ``shown`` most alike
    as (score, neg, the negative id), best first.

    Equal names are compared once: pairs are those of distinct names, and a name stands for all its companies by their
    number and smallest ids.
    """
    asked = cut(candidates.groupBy("name").agg(F.min("input_index").alias("input_index")).withColumn("grams", _grams()))
    known = cut(companies.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).withColumn("grams", _grams()))
    found = cut(_alike_names(asked, known, shown))
    if shown > 1:
        # of names in the order of score and smallest id, the first ``shown`` hold the ``shown`` most alike companies
        front = found.select("input_index", F.explode("top").alias("t")).select("input_index", "t.score", (-F.col("t.neg")).alias("id")).join(known.select("id", "name"), "id").select("input_index", "score", "name")
        least = companies.select("id", "name").join(front.select("name").distinct(), "name", "left_semi")
        front = front.join(_first(least, shown, "name", "id").groupBy("name").agg(F.collect_list("id").alias("ids")), "name").select("input_index", "score", F.explode("ids").alias("id"))
        front = front.groupBy("input_index").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("id")).alias("neg"))), False), 1, shown).alias("top"))
        found = found.drop("top").join(front, "input_index")
    found = found.join(asked, "input_index").select("name", "match_count", "top")
    hot = hot_keys(candidates.groupBy("name").agg(F.count(F.lit(1)).alias("_n")), "name", "_n", candidates.count())
    return salted_join(candidates.select("input_index", "name"), found, "name", hot, ["input_index"]).select("input_index", "match_count", "top")


def _resolved(candidates: DataFrame, companies: DataFrame, shown: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates trimmed; token matches: input_index, id; by name and host: input_index, id, p (strength); by trigrams: input_index, match_count, top)."""
    companies = cut(companies.select("id", "name", "ats", "board_token", "careers_page_url"))  # each kind of match reads it
    cand = candidates.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).withColumn("careers_url", F.when(X.url_valid(F.trim("careers_url")), F.trim("careers_url")))
    valid = cand.where("name <> ''")
    token = valid.where("trim(ats) <> '' and trim(board_token) <> ''").select("input_index", F.trim("ats").alias("ats"), F.trim("board_token").alias("board_token"))
    by_token = cut(token.join(companies.select("id", "ats", "board_token"), ["ats", "board_token"]).groupBy("input_index").agg(F.min("id").alias("id")))
    rest = valid.join(by_token.select("input_index"), "input_index", "left_anti")
    exact = name_matches(rest, companies).select("input_index", "id", F.lit(2).alias("p")).unionByName(host_matches(rest, companies).select("input_index", "id", F.lit(3).alias("p")))
    exact = exact.groupBy("input_index", "id").agg(F.max("p").alias("p"))
    left = cut(rest.join(exact.select("input_index").distinct(), "input_index", "left_anti").select("input_index", "name"))
    return cand, by_token, exact, _fuzzy_by_name(left, companies, shown)


def matches(candidates: DataFrame, companies: DataFrame, shown: int = FUZZY_SHOWN) -> DataFrame:
    """input_index, id, match_kind, score, match_count: every match of each candidate, a company once and by its strongest kind.

    A token match is the only one. Of matches by trigrams, which there are only where nothing else matches, the ``shown``
    most alike are given (ties to the smaller id); match_count counts those that aren't, too.
    """
    _, by_token, exact, fuzzy = _resolved(candidates, companies, shown)
    counts = exact.groupBy("input_index").agg(F.count(F.lit(1)).alias("match_count"))
    out = exact.join(counts, "input_index").select("input_index", "id", F.when(F.col("p") == 3, "domain").otherwise("name_only").alias("match_kind"), F.lit(1.0).alias("score"), "match_count")
    alike = fuzzy.select("input_index", "match_count", F.explode("top").alias("m"))
    out = out.unionByName(alike.select("input_index", (-F.col("m.neg")).alias("id"), F.lit("fuzzy_name").alias("match_kind"), "m.score", "match_count"))
    return out.unionByName(by_token.select("input_index", "id", F.lit("token").alias("match_kind"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("match_count")))


def verdicts(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """input_index, verdict, match_kind, match_count, matched_id of each candidate (input_index, name, ats, board_token, careers_url).

    A token match decides at once: duplicate if the company has a recent snapshot, else stale. Otherwise any match by
    host or name, or, only where there is none, by trigrams, is stale; nothing at all is new; a blank name is invalid.
    Of several matches the strongest kind leads, then the higher score, then the smaller id.
    """
    cand, by_token, exact, fuzzy = _resolved(candidates, companies)
    # whether a company was fetched lately is asked of those that a token found alone
    by_token = by_token.join(companies.select("id", "has_recent_snapshot"), "id").groupBy("input_index").agg(F.min(F.struct("id", "has_recent_snapshot")).alias("t"))
    best = exact.groupBy("input_index").agg(F.count(F.lit(1)).alias("match_count"), F.max(F.struct("p", F.lit(1.0).alias("score"), (-F.col("id")).alias("neg"))).alias("b"))
    first = F.element_at("top", 1)
    best = best.unionByName(fuzzy.select("input_index", "match_count", F.struct(F.lit(1).alias("p"), first["score"].alias("score"), first["neg"].alias("neg")).alias("b")))
    out = cand.select("input_index", "name").join(by_token, "input_index", "left").join(best, "input_index", "left")
    kind = F.when(F.col("t").isNotNull(), "token").when(F.col("b.p") == 3, "domain").when(F.col("b.p") == 2, "name_only").when(F.col("b.p") == 1, "fuzzy_name").otherwise("none")
    verdict = F.when(F.col("name") == "", "invalid").when(F.col("t.has_recent_snapshot"), "duplicate").when(F.col("t").isNotNull() | F.col("b").isNotNull(), "stale").otherwise("new")
    return out.select("input_index", verdict.alias("verdict"), kind.alias("match_kind"), F.when(F.col("t").isNotNull(), F.lit(1)).otherwise(F.coalesce("match_count", F.lit(0))).cast("long").alias("match_count"), F.coalesce(F.col("t.id"), -F.col("b.neg")).alias("matched_id"))


def known_unsupported(candidates: DataFrame, registry: DataFrame, as_of: Column, days: int = REVISIT_DAYS) -> DataFrame:
    """input_index, name, reason, last_checked_at, stale: the registry's record of each candidate; a host match beats a name match, the last checked wins."""
    rows = registry.select(F.col("id").alias("rid"), F.col("name").alias("rname"), "reason", "last_checked_at", X.normalize_name(F.col("name")).alias("_k"), X.url_host(F.col("url")).alias("_h"))
    found = []
    for key, c in (("_k", X.normalize_name(F.col("name"))), ("_h", X.url_host(F.col("careers_url")))):
        met = candidates.select("input_index", c.alias(key)).join(rows, key).withColumn("by_host", F.lit(key == "_h"))
        found.append(met.select("input_index", "by_host", "last_checked_at", "rid", "rname", "reason"))
    best = latest_per_key(found[0].unionByName(found[1]), ["input_index"], ["by_host", "last_checked_at", "rid"])
    return best.select("input_index", F.col("rname").alias("name"), "reason", "last_checked_at", (F.col("last_checked_at") < as_of - F.make_dt_interval(F.lit(days))).alias("stale"))


def detect_evidence(urls: DataFrame) -> DataFrame:
    """input_index, status, ats, board_token from (input_index, url) evidence: any bad address makes it invalid-input; else no,
    one or several distinct boards mean unsupported-ats, detected, ambiguous."""
    seen = urls.withColumn("d", X.detect_board(F.col("url"))).groupBy("input_index").agg(F.bool_and(X.url_valid(F.col("url"))).alias("ok"), F.count_distinct(F.when(F.col("d").isNotNull(), F.struct("d.ats", "d.board_token"))).alias("n"), F.min(F.struct("d.ats", "d.board_token")).alias("m"), F.min(F.when(F.col("d").isNotNull(), F.struct("d.ats", "d.board_token"))).alias("f"))
    status = F.when(~F.col("ok"), "invalid-input").when(F.col("n") == 0, "unsupported-ats").when(F.col("n") == 1, "detected").otherwise("ambiguous")
    one = status == "detected"
    return seen.select("input_index", status.alias("status"), F.when(one, F.col("f.ats")).alias("ats"), F.when(one, F.col("f.board_token")).alias("board_token"))


def onboarding_state(records: DataFrame) -> DataFrame:
    """The next state of each research record joined with what its probes and look-ups gave: columns status, verdict,
    careers_ok, detection, board_ok. Finished records stay; each check stops at the first that fails."""
    done = F.col("status").isin("verified", "duplicate", "stale-needs-merge", "no-careers", "unsupported-ats", "invalid-token")
    state = (
        F.when(done, F.col("status")).when(F.col("verdict") == "duplicate", "duplicate").when(F.col("verdict") == "stale", "stale-needs-merge").when(~F.coalesce("careers_ok", F.lit(False)), "no-careers")
        .when(F.coalesce("detection", F.lit("")) != "detected", "unsupported-ats").when(~F.coalesce("board_ok", F.lit(False)), "invalid-token").otherwise("verified")
    )
    return records.withColumn("next_status", state)


#: States in which a research record stays, besides being verified.
FINISHED = ("duplicate", "stale-needs-merge", "no-careers", "unsupported-ats", "invalid-token")


def _by_board(records: DataFrame, boards: DataFrame) -> DataFrame:
    """(record_id, _pair) joined with a row of each board; one board may have very many records."""
    hot = hot_keys(records.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n")), "_pair", "_n", records.count())
    return salted_join(records, boards, "_pair", hot, ["record_id"])


def onboard(records: DataFrame, companies: DataFrame) -> DataFrame:
    """``records`` (record_id, status, verified_at, url, careers_url, careers_ok, ats, board_token) as far as they come without
    a board's answer: next_status, null for those still open; missing, what an open record lacks; ats and board_token, those
    detected included. Open records that lack nothing have a board to ask; onboard_boards() takes the answers.

    Finished and verified records stay as they are. A given board is looked up among the companies; where none is given it is
    detected from the careers address, even if that doesn't answer, and then looked up in the same way: of a known company it is
    a duplicate if that was fetched lately, else stale. Blank addresses are missing ones; a board without a source name or token
    can't be asked. ``companies``: ats, board_token, has_recent_snapshot; of several with one board the recent one counts.
    """
    status = F.coalesce("status", F.lit(""))
    blank = lambda c: F.coalesce(X.strip(F.col(c)), F.lit("")) == ""
    done = status.isin("verified", *FINISHED) | F.col("verified_at").isNotNull()
    lacks = F.when(blank("url"), "url").when(blank("careers_url") & F.col("ats").isNull(), "careers_url")
    rows = records.withColumn("_done", done).withColumn("missing", F.when(~done, lacks)).withColumn("_open", ~done & F.col("missing").isNull())
    # through a generator, so that the detection isn't repeated wherever its result is read
    rows = rows.select("*", F.explode(F.array(F.when(F.col("_open") & F.col("ats").isNull(), X.detect_board(F.col("careers_url"))))).alias("_found"))
    unknown = F.col("_open") & F.col("ats").isNull() & F.col("_found").isNull()
    rows = rows.withColumn("_unknown", unknown).withColumn("board_token", F.when(F.col("_found").isNotNull(), F.col("_found.board_token")).otherwise(F.col("board_token"))).withColumn("ats", F.coalesce("ats", "_found.ats"))
    pair = F.struct("ats", "board_token")
    known = companies.where("ats is not null and board_token is not null").groupBy(pair.alias("_pair")).agg(F.max("has_recent_snapshot").alias("_recent"))
    asked = rows.where("_open and not _unknown and ats is not null and board_token is not null").select("record_id", pair.alias("_pair"))
    met = _by_board(asked, known).select("record_id", "_recent")
    rows = rows.join(met, "record_id", "left")
    lost = F.when(F.coalesce("careers_ok", F.lit(False)), "unsupported-ats").otherwise("no-careers")
    state = F.when(F.col("verified_at").isNotNull() & ~status.isin(*FINISHED), "verified").when(F.col("_done"), F.col("status")).when(~F.col("_open"), None).when(F.col("_recent"), "duplicate").when(F.col("_recent").isNotNull(), "stale-needs-merge").when(F.col("_unknown"), lost)
    rows = rows.withColumn("next_status", state)
    still = F.col("_open") & F.col("next_status").isNull()
    rows = rows.withColumn("missing", F.when(still & ((F.coalesce("ats", F.lit("")) == "") | (F.coalesce("board_token", F.lit("")) == "")), "ats-or-board-token").otherwise(F.col("missing")))
    rows = rows.withColumn("next_status", F.when(still & F.col("missing").isNull() & ~F.col("ats").isin(*SOURCES), "unsupported-ats").otherwise(F.col("next_status")))
    return rows.drop("_done", "_open", "_found", "_unknown", "_recent")


def onboard_boards(opened: DataFrame, boards: DataFrame) -> DataFrame:
    """Records of onboard() after their boards (ats, board_token, ok) were asked: verified or invalid-token; a board without an answer
    leaves its records open. Of several answers a good one counts."""
    pair = F.struct("ats", "board_token")
    open_ = opened.where("next_status is null and missing is null").select("record_id", pair.alias("_pair"))
    answer = boards.where("ats is not null and board_token is not null and ok is not null").groupBy(pair.alias("_pair")).agg(F.max("ok").alias("_ok"))
    met = _by_board(open_, answer).select("record_id", "_ok")
    out = opened.join(met, "record_id", "left")
    return out.withColumn("next_status", F.coalesce("next_status", F.when(F.col("_ok"), "verified").when(F.col("_ok").isNotNull(), "invalid-token"))).drop("_ok")


def onboarding_summary(records: DataFrame) -> DataFrame:
    """status, n of research records after a run: how many stand in each state."""
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
