"""FLT, TOP, SET, HIST, WIN, AGG, SCO, CDC: filters, histories and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import fold_sql, half_up_sql, register
from hearthmark.functions import scoring, text
from hearthmark.functions.numbers import half_up
from hearthmark.operators import alerts, history, market, qualification, reports, runs
from hearthmark.operators.relevance import criteria_rows, with_polygons
from hearthmark.operators.zones import map_layers

NOW = "2024-01-10 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def text_of(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


PCT_SQL = "case when {a} <> 0 and {b} <> 0 then floor(({b} - {a}) / {a} * 1000 + 0.5) / 10 end"

# ---------------------------------------------------------------- filters
STATUS_SQL = """
    select listing_id, max_by(status, seq) as status from qualification_log where action = 'status' group by 1"""


def _statuses(t):
    log = t("qualification_log").where("action = 'status'").select("listing_id", "status", "seq")
    return history.latest_row(log, ["listing_id"], ["seq"])


register(
    "FLT-1",
    lambda t: text_of(
        reports.search_listings(
            t("listings"), _statuses(t), query=" On", status="contactee", order="price_desc"
        ).select("id", "title", "city", "price", "last_changed_at"),
        "last_changed_at",
    ),
    f"""select id, title, city, price, cast(last_changed_at as varchar) as last_changed_at from listings
        where contains(lower(coalesce(title, '') || ' ' || coalesce(city, '')), 'on')
          and id in (select listing_id from ({STATUS_SQL}) s where status = 'contactee')
        order by price desc nulls last, id""",
    "listings",
    "qualification_log",
)
register(
    "FLT-2",
    lambda t: t("documents").select(
        "doc_id",
        *[
            text.contains_keyword(F.col("text"), F.lit(word)).alias(name)
            for name, word in (("has_plain", "the"), ("has_accent", " DÉ LA "), ("has_blank", "  "), ("has_rare", "éènon"))
        ],
    ),
    f"""select doc_id, contains(f, 'the') as has_plain, contains(f, 'de la') as has_accent, false as has_blank,
               contains(f, 'eenon') as has_rare
        from (select doc_id, {fold_sql('text')} as f from documents) d""",
)


def _layers(t):
    searches = with_polygons(criteria_rows(t("searches")).drop("polygon"), t("vertices"))
    located, circles, polygons = map_layers(t("listings"), searches)
    return (
        located.select(F.lit("listing").alias("layer"), F.col("id").cast("bigint").alias("ref"))
        .unionByName(circles.select(F.lit("circle").alias("layer"), F.col("search_id").cast("bigint").alias("ref")))
        .unionByName(polygons.select(F.lit("polygon").alias("layer"), F.col("search_id").cast("bigint").alias("ref")))
    )


register(
    "FLT-3",
    _layers,
    """select 'listing' as layer, id as ref from listings where lat is not null and lng is not null
       union all select 'circle', search_id from searches where active and center_lat is not null
         and center_lng is not null and radius_km is not null and radius_km <> 0
       union all select 'polygon', s.search_id from searches s
         join (select search_id from vertices group by 1 having count(*) >= 3) v using (search_id) where active""",
    "listings",
    "searches",
    "vertices",
)
register(
    "FLT-4",
    lambda t: text_of(runs.due_searches(t("searches"), now()), "last_run_at"),
    f"""select search_id, user_id, name, frequency, cast(last_run_at as varchar) as last_run_at from searches where active and (
          (frequency = 'hourly' and (last_run_at is null or last_run_at < timestamp '{NOW}' - interval 55 minute))
          or (frequency = 'daily' and (last_run_at is null or last_run_at < timestamp '{NOW}' - interval 23 hour)))""",
    "searches",
)
register(
    "FLT-5",
    lambda t: runs.refresh_gate(t("searches"), now()).select("search_id", "name", "status"),
    f"""select search_id, name, case when last_run_at is not null and
          epoch(timestamp '{NOW}') - epoch(last_run_at) < 600 then 'too-recent' else 'run' end as status
        from searches where is_public and active""",
    "searches",
)
register(
    "FLT-6.unread",
    lambda t: alerts.unread(t("notifications")).groupBy("user_id").agg(F.count(F.lit(1)).alias("unread")),
    "select user_id, count(*) as unread from notifications where read_at is null group by 1",
    "notifications",
)
register(
    "FLT-6.queue",
    lambda t: text_of(alerts.dispatch_queue(t("notifications")), "created_at").select("notification_id", "user_id", "created_at"),
    """select notification_id, user_id, cast(created_at as varchar) as created_at from notifications
       where dispatched_at is null order by created_at, notification_id""",
    "notifications",
)

# ---------------------------------------------------------------- sorts and limits
register(
    "TOP-1",
    lambda t: text_of(reports.recent_changes(t("listings")).select("id", "title", "last_changed_at"), "last_changed_at"),
    """select id, title, cast(last_changed_at as varchar) as last_changed_at from listings
       order by listings.last_changed_at desc, id limit 4""",
    "listings",
)
register(
    "TOP-3.local",
    lambda t: text_of(runs.newest_runs(runs.normalise_runs(t("run_rows")), 50), "at").select("run_id", "at", "status"),
    """select run_id, cast("at" as varchar) as "at", case when status in ('success', 'error') then status else 'partial' end as status
       from (select *, coalesce(finished_at, started_at, created_at) as "at" from run_rows) r order by r."at" desc, run_id desc limit 50""",
    "run_rows",
)
register(
    "TOP-3.server",
    lambda t: text_of(
        t("run_rows").orderBy(F.desc("created_at"), F.desc("run_id")).limit(100).select("run_id", "created_at"), "created_at"
    ),
    """select run_id, cast(created_at as varchar) as created_at from run_rows order by run_rows.created_at desc, run_id desc limit 100""",
    "run_rows",
)
register(
    "TOP-4",
    lambda t: text_of(
        t("notifications").orderBy(F.desc("created_at"), F.desc("notification_id")).select("notification_id", "title", "created_at"),
        "created_at",
    ),
    """select notification_id, title, cast(created_at as varchar) as created_at from notifications
       order by notifications.created_at desc, notification_id desc""",
    "notifications",
)


def _ordered(t, order):
    priced = t("listings").withColumns(
        {
            "price": F.when(F.col("id") % 6 != 1, F.col("price")),
            "relevance_score": F.when(F.col("id") % 5 != 0, (F.col("price") % 101).cast("int")),
        }
    )
    return reports.sorted_listings(priced, order).select("id", "price", "relevance_score")


for _order, _sql in (
    ("price_asc", "price asc nulls last"),
    ("price_desc", "price desc nulls last"),
    ("relevance", "coalesce(relevance_score, 0) desc"),
    ("recent", "last_changed_at desc"),
):
    register(
        f"TOP-5.{_order}",
        lambda t, order=_order: _ordered(t, order),
        f"""select id, price, relevance_score from (
              select id, last_changed_at, case when id % 6 <> 1 then price end as price,
                     case when id % 5 <> 0 then cast(price % 101 as int) end as relevance_score from listings) l
            order by {_sql}, id""",
        "listings",
    )

# ---------------------------------------------------------------- set operations


def _both_logs(t):
    rows = runs.normalise_runs(t("run_rows"))
    local = t("notifications").select(
        F.col("notification_id").alias("run_id"),
        F.col("created_at").alias("at"),
        F.lit("manual").alias("run_trigger"),
        F.lit("success").alias("status"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("added", "updated", "warnings")],
    )
    return text_of(runs.all_runs(local, rows), "at")


register(
    "SET-1",
    _both_logs,
    """select notification_id as run_id, cast(created_at as varchar) as "at", 'manual' as run_trigger, 'success' as status,
              cast(0 as bigint) as added, cast(0 as bigint) as updated, cast(0 as bigint) as warnings from notifications
       union all
       select run_id, cast(coalesce(finished_at, started_at, created_at) as varchar),
              case when run_trigger = 'manual' then 'manual' else 'schedule' end,
              case when status in ('success', 'error') then status else 'partial' end,
              coalesce(added, 0), coalesce(updated, 0), coalesce(warnings, 0) from run_rows""",
    "notifications",
    "run_rows",
)
register(
    "SET-5",
    lambda t: qualification.toggled_tags(t("qualification_log")),
    "select listing_id, tag from qualification_log where action = 'tag' group by 1, 2 having count(*) % 2 = 1",
    "qualification_log",
)

# ---------------------------------------------------------------- histories


def _flat_deltas(t):
    d = history.version_deltas(t("versions"))
    columns = [F.col(f"{f}.{side}").alias(f"{f}_{side}") for f in ("price", *history.NUMERIC_FIELDS, "status") for side in ("from", "to")]
    return d.select("listing_id", "tiebreak", "changed", F.col("price.pct").alias("price_pct"), "title_changed", "description_changed", *columns)


_DELTA_COLUMNS = ", ".join(
    f"case when p_{f} is distinct from {f} then p_{f} end as {f}_from, case when p_{f} is distinct from {f} then {f} end as {f}_to"
    for f in ("price", *history.NUMERIC_FIELDS)
)
_DELTA_LAGS = ", ".join(
    f"lag({f}) over w as p_{f}" for f in ("price", *history.NUMERIC_FIELDS, "title", "description", "source_status")
)
_DELTA_ANY = " or ".join(f"p_{f} is distinct from {f}" for f in ("price", *history.NUMERIC_FIELDS))
_BLANK_DIFF = "coalesce(p_{0}, '') <> coalesce({0}, '')"
register(
    "HIST-1",
    _flat_deltas,
    f"""select listing_id, tiebreak, {_DELTA_ANY} or {' or '.join(_BLANK_DIFF.format(f) for f in ('title', 'description', 'source_status'))} as changed,
               case when p_price is distinct from price then {PCT_SQL.format(a='p_price', b='price')} end as price_pct,
               {_BLANK_DIFF.format('title')} as title_changed, {_BLANK_DIFF.format('description')} as description_changed,
               {_DELTA_COLUMNS},
               case when {_BLANK_DIFF.format('source_status')} then p_source_status end as status_from,
               case when {_BLANK_DIFF.format('source_status')} then source_status end as status_to
        from (select *, {_DELTA_LAGS}, row_number() over w as rn from versions
              window w as (partition by listing_id order by captured_at, tiebreak)) v where rn > 1""",
    "versions",
)
register(
    "HIST-2",
    lambda t: text_of(history.price_change_points(t("versions")), "observed_at"),
    """select listing_id, cast(captured_at as varchar) as observed_at, tiebreak, price
       from (select *, lag(price) over (partition by listing_id order by captured_at, tiebreak) as p
             from versions where price is not null) v where p is null or p <> price""",
    "versions",
)
register(
    "AGG-1",
    lambda t: history.price_summary(t("price_points")),
    f"""select listing_id, first, last, min, max, drops, {PCT_SQL.format(a='first', b='last')} as change_pct,
               case when {PCT_SQL.format(a='first', b='last')} < 0 then 'down'
                    when {PCT_SQL.format(a='first', b='last')} > 0 then 'up' else 'flat' end as direction
        from (select listing_id, arg_min(price, observed_at) as first, arg_max(price, observed_at) as last, min(price) as min,
                     max(price) as max, cast(count(*) filter (price < p) as bigint) as drops
              from (select *, lag(price) over (partition by listing_id order by observed_at, tiebreak) as p from price_points) x
              group by 1) s""",
    "price_points",
)
register(
    "WIN-1",
    lambda t: history.drop_counts(t("price_points"), "listing_id", "observed_at", "price", "tiebreak"),
    """select listing_id, count(*) filter (price < p) as drops from (
         select *, lag(price) over (partition by listing_id order by observed_at, tiebreak) as p from price_points) x group by 1""",
    "price_points",
)
register(
    "WIN-2",
    lambda t: history.first_last(t("price_points"), "listing_id", "observed_at", "price", "tiebreak"),
    """select distinct listing_id, first_value(price) over w as first_value, last_value(price) over w as last_value
       from price_points window w as (partition by listing_id order by observed_at, tiebreak
         rows between unbounded preceding and unbounded following)""",
    "price_points",
)
register(
    "WIN-3",
    lambda t: text_of(
        history.latest_row(t("qualification_log").select("listing_id", "seq", "at", "action"), ["listing_id"], ["at", "seq"]), "at"
    ),
    """select listing_id, seq, cast("at" as varchar) as "at", action from (
         select *, row_number() over (partition by listing_id order by "at" desc, seq desc) as rn from qualification_log) q where rn = 1""",
    "qualification_log",
)
register(
    "WIN-4",
    lambda t: history.latest_row(
        t("edges").withColumn("_low", -F.col("b")).withColumn("_low_seq", -F.col("seq")), ["a"], ["score", "_low", "_low_seq"]
    ).select("a", "b", "score", "bucket"),
    """select a, b, score, bucket from (
         select *, row_number() over (partition by a order by score desc, b, seq) as rn from edges) e where rn = 1""",
    "edges",
)
register(
    "WIN-5",
    lambda t: market.rank_quantiles(
        t("price_points").withColumn("whole", half_up(F.col("price"))), ["listing_id"], "whole"
    ).select("listing_id", "count", "p25", "median", "p75"),
    """select listing_id, max(n) as count, """
    + ", ".join(
        f"max(v) filter (rn - 1 = least(n - 1, cast(floor({p} * n) as bigint))) as {name}"
        for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))
    )
    + """ from (select listing_id, cast(floor(price + 0.5) as bigint) as v,
                  row_number() over (partition by listing_id order by price) as rn, count(*) over (partition by listing_id) as n
           from price_points) x group by 1""",
    "price_points",
)
register(
    "WIN-6",
    lambda t: history.scaled_series(t("price_points"), "listing_id", "observed_at", "price", "tiebreak").select(
        "listing_id", "tiebreak", F.col("position").cast("bigint").alias("position"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    ),
    """select listing_id, tiebreak, rn as position, round((rn - 1) * (100.0::double / (n - 1)), 6) as x,
              round(30 - (price - low) / (case when high = low then 1 else high - low end) * 30, 6) as y
       from (select *, row_number() over (partition by listing_id order by observed_at, tiebreak) as rn,
                    count(*) over g as n, min(price) over g as low, max(price) over g as high
             from price_points window g as (partition by listing_id)) x where n >= 2""",
    "price_points",
)

# ---------------------------------------------------------------- aggregates
_MARKET_SQL = """
    select k.area, k.type_local, coalesce(n, 0) as count, median, p25, p75 from (select distinct area, type_local from {src}) k
    left join (select area, type_local, max(n) as n,
        cast(floor(max(ppm) filter (rn - 1 = least(n - 1, cast(floor(0.5 * n) as bigint))) + 0.5) as bigint) as median,
        cast(floor(max(ppm) filter (rn - 1 = least(n - 1, cast(floor(0.25 * n) as bigint))) + 0.5) as bigint) as p25,
        cast(floor(max(ppm) filter (rn - 1 = least(n - 1, cast(floor(0.75 * n) as bigint))) + 0.5) as bigint) as p75
      from (select area, type_local, value / surface as ppm,
                   row_number() over (partition by area, type_local order by value / surface) as rn,
                   count(*) over (partition by area, type_local) as n
            from {src} where value > 0 and surface > 5 and value / surface between 200 and 50000) x group by 1, 2) s
    on s.area = k.area and s.type_local = k.type_local"""
register(
    "AGG-2", lambda t: market.market_reference(t("transactions")), _MARKET_SQL.format(src="transactions"), "transactions"
)
register(
    "AGG-3",
    lambda t: market.market_reference(market.latest_year(t("transactions"))),
    "with recent as (select t.* from transactions t join (select area, max(year) as year from transactions "
    "where year in (2024, 2023, 2022) group by 1) m on m.area = t.area and m.year = t.year) "
    + _MARKET_SQL.format(src="recent"),
    "transactions",
)
register(
    "AGG-4",
    lambda t: text_of(runs.run_metrics(runs.normalise_runs(t("run_rows"))), "last_at"),
    """select count(*) as total, count(*) filter (status = 'success') as success,
              count(*) filter (status not in ('success', 'error')) as partial, count(*) filter (status = 'error') as error,
              cast(floor(count(*) filter (status = 'success') / count(*) * 100 + 0.5) as bigint) as success_rate,
              cast(sum(coalesce(added, 0)) as bigint) as total_added, cast(sum(coalesce(updated, 0)) as bigint) as total_updated,
              cast(sum(coalesce(warnings, 0)) as bigint) as total_warnings,
              cast(max(coalesce(finished_at, started_at, created_at)) as varchar) as last_at
       from run_rows""",
    "run_rows",
)
register(
    "AGG-5",
    lambda t: runs.dashboard(t("listings"), t("searches"), t("notifications"), t("edges")),
    """select 'listings' as kpi, count(*) as value from listings
       union all select 'active_searches', count(*) from searches where active
       union all select 'unread', count(*) from notifications where read_at is null
       union all select 'duplicates', count(*) from edges where bucket in ('doublon_exact', 'probable_identique')""",
    "listings",
    "searches",
    "notifications",
    "edges",
)
register("AGG-7", lambda t: t("incoming").select("source_id").distinct(), "select distinct source_id from incoming", "incoming")

_OUTCOME_SQL = """
    select n.*, p.user_id is not null and p.has_webhook as hook, coalesce(p.webpush_enabled, false) as pushing,
           coalesce(s.subs, 0) as subs, coalesce(a.hook_ok, 0) as hook_ok, coalesce(a.sent, 0) as sent, coalesce(a.failed, 0) as failed
    from notifications n left join preferences p using (user_id)
    left join (select user_id, count(*) as subs from subscriptions group by 1) s using (user_id)
    left join (select notification_id, count(*) filter (channel = 'webhook' and status_code between 200 and 299) as hook_ok,
                      count(*) filter (channel = 'push' and status_code between 200 and 299) as sent,
                      count(*) filter (channel = 'push' and status_code not between 200 and 299) as failed
               from attempts group by 1) a using (notification_id)"""
_OUTCOME_COLUMNS = """
    case when not coalesce(hook, false) then 'skipped' when hook_ok > 0 then 'sent' else 'failed' end as webhook,
    case when not pushing then 'skipped' when subs = 0 then 'no_subscription' when failed = 0 then 'sent'
         when sent = 0 then 'failed' else 'partial' end as push,
    case when pushing then sent else 0 end as push_sent, case when pushing then failed else 0 end as push_failed"""


def _outcomes(t):
    return alerts.delivery_outcomes(t("notifications"), t("preferences"), t("subscriptions"), t("attempts"))


register(
    "AGG-9",
    lambda t: _outcomes(t).select("notification_id", "webhook", "push", "push_sent", "push_failed"),
    f"select notification_id, {_OUTCOME_COLUMNS} from ({_OUTCOME_SQL}) o",
    "notifications",
    "preferences",
    "subscriptions",
    "attempts",
)
register(
    "AGG-9.expired",
    lambda t: alerts.expired_subscriptions(t("attempts")),
    "select distinct subscription_id from attempts where channel = 'push' and status_code in (404, 410)",
    "attempts",
)
register(
    "AGG-10",
    lambda t: runs.event_counts(
        t("run_rows").select(
            "run_id",
            F.when(F.col("status") == "success", "info").otherwise("warn").alias("level"),
            F.when(F.col("run_trigger") == "manual", "normalize").otherwise("collect").alias("step"),
        )
        .unionByName(t("run_rows").select("run_id", F.lit("info").alias("level"), F.lit("collect").alias("step")))
    ),
    """select run_id, level, step, count(*) as events from (
         select run_id, case when status = 'success' then 'info' else 'warn' end as level,
                case when run_trigger = 'manual' then 'normalize' else 'collect' end as step from run_rows
         union all select run_id, 'info', 'collect' from run_rows) e group by 1, 2, 3""",
    "run_rows",
)

# ---------------------------------------------------------------- scores
register(
    "SCO-2",
    lambda t: t("notifications").select("notification_id", scoring.freshness(F.col("created_at"), now()).alias("freshness")),
    f"""select notification_id, cast(floor(100 * exp(-greatest(0, (epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 3600000000.0::double) / 72) + 0.5) as int) as freshness
        from notifications""",
    "notifications",
)


def _price_moves(t):
    return history.with_previous(
        t("price_points"), ["listing_id"], ["observed_at", "tiebreak"], ["price"], history.day("observed_at")
    ).withColumn("_before", F.col("previous")["price"])


register(
    "SCO-3",
    lambda t: _price_moves(t)
    .withColumn("_d", scoring.price_drop(F.col("_before"), F.col("price")))
    .select(
        F.col("tiebreak").alias("event_id"),
        F.col("_d.dropped").alias("dropped"),
        F.round("_d.delta_abs", 6).alias("delta_abs"),
        F.round("_d.delta_pct", 6).alias("delta_pct"),
    ),
    """select tiebreak as event_id, coalesce(ok and (price - p) / p * 100 <= -3, false) as dropped,
              round(case when ok then price - p else 0 end, 6) as delta_abs,
              round(case when ok then (price - p) / p * 100 else 0 end, 6) as delta_pct
       from (select *, p is not null and price is not null and p > 0 as ok from (
         select *, lag(price) over (partition by listing_id order by observed_at, tiebreak) as p from price_points) y) x""",
    "price_points",
)


def _change_kinds(t):
    fields = ["price", "media_count", "source_status", "title"]
    rows = history.with_previous(t("versions"), ["listing_id"], ["captured_at", "tiebreak"], fields, history.day("captured_at"))
    rows = rows.where(F.col("previous").isNotNull())

    def side(get):
        return {"price": get("price"), "media_count": get("media_count"), "status": get("source_status"), "fingerprint": get("title")}

    before, after = side(lambda f: F.col("previous")[f]), side(F.col)
    # alternate roles hide every other change, so each second row drops its status
    quiet = {**before, "status": F.when(F.col("tiebreak") % 2 == 0, before["status"])}
    return rows.select("listing_id", "tiebreak", scoring.change_kind(quiet, after).alias("kind"))


register(
    "SCO-4",
    _change_kinds,
    """select listing_id, tiebreak, case
         when tiebreak % 2 = 0 and p_status <> source_status then 'status_change'
         when p_price > 0 and (price - p_price) / p_price * 100 <= -3 then 'price_drop'
         when price > p_price then 'price_rise'
         when media_count <> p_media then 'media_change'
         when title <> p_title and title <> '' and p_title <> '' then 'text_change' else 'none' end as kind
       from (select *, lag(price) over w as p_price, lag(media_count) over w as p_media, lag(source_status) over w as p_status,
                    lag(title) over w as p_title, row_number() over w as rn from versions
             window w as (partition by listing_id order by captured_at, tiebreak)) v where rn > 1""",
    "versions",
)
register(
    "SCO-5",
    lambda t: t("edges")
    .withColumn("_r", scoring.republication(F.col("seq") % 3 == 0, F.col("a") != F.col("b") % 40, F.col("score")))
    .select("seq", "_r.*"),
    """select seq, a <> b % 40 and score >= 78 as recycled,
              cast(case when a = b % 40 then 0 when score < 78 then score else least(100, score + case when seq % 3 = 0 then 10 else 0 end) end as int) as confidence,
              case when a = b % 40 then 'Même identifiant source.'
                   when score < 78 then 'Similarité insuffisante (' || score || '/100).'
                   when seq % 3 = 0 then 'Annonce quasi identique (' || score || '/100) republiée après disparition de la précédente.'
                   else 'Annonce quasi identique (' || score || '/100) sous un autre identifiant.' end as reason
       from edges""",
    "edges",
)


def _market_gap(t):
    sales = t("transactions").withColumn(
        "type_local", F.when(F.col("type_local").isin("STANDARD", "SMALL"), "Appartement").otherwise("Maison")
    )
    homes = t("listings").withColumn("area", (F.col("id") % 25).cast("int"))
    gaps = market.compare_to_market(homes, market.market_reference(sales))
    return gaps.select("id", "area", "type_local", F.round("per_m2", 6).alias("per_m2"), "median", "pct", "over")


register(
    "SCO-6",
    _market_gap,
    "with sales as (select area, case when type_local in ('STANDARD', 'SMALL') then 'Appartement' else 'Maison' end as type_local, value, surface from transactions), "
    "reference as (" + _MARKET_SQL.format(src="sales") + ") "
    """select id, l.area, l.type_local, round(per_m2, 6) as per_m2, median,
              cast(case when per_m2 <> 0 and median <> 0 then floor((per_m2 - median) / median * 100 + 0.5) end as int) as pct,
              case when per_m2 <> 0 and median <> 0 then floor((per_m2 - median) / median * 100 + 0.5) > 0 end as over
       from (select id, cast(id % 25 as int) as area, case when surface_m2 > 0 then price / surface_m2 end as per_m2,
                    case when property_type like '%appart%' then 'Appartement' when property_type like '%maison%' then 'Maison' end as type_local
             from listings) l left join reference r on r.area = l.area and r.type_local = l.type_local""",
    "transactions",
    "listings",
)

# ---------------------------------------------------------------- folds of action logs
register(
    "CDC-1",
    lambda t: qualification.fold_qualification(t("qualification_log")).withColumn("tags", F.array_join("tags", ",")),
    """with steps as (select *, case when action = 'status' then status when action = 'verification'
           then case when verified then 'verifiee' when anomaly_count > 0 then 'suspecte' end end as s from qualification_log),
       cur as (select listing_id, coalesce(arg_max(s, seq) filter (s is not null), 'a_revoir') as status from steps
               where s is not null or action = 'tag' group by 1),
       tags as (select listing_id, string_agg(tag, ',' order by tag) as tags from (
           select listing_id, tag from qualification_log where action = 'tag' group by 1, 2 having count(*) % 2 = 1) x group by 1)
       select cur.listing_id, status, coalesce(tags, '') as tags from cur left join tags using (listing_id)""",
    "qualification_log",
)
def _read_log(t):
    """Log entries of notifications under their owners, and sweeps of all forty users."""
    log = t("read_log").withColumn("user_id", F.col("user_id") + 10 * (F.col("seq") % 4)).withColumn("seq", F.unix_micros(F.col("at").cast("timestamp")))
    owners = t("notifications").select("notification_id", F.col("user_id").alias("_owner"))
    own = log.where("action <> 'read_all'").join(owners, "notification_id").withColumn("user_id", F.col("_owner")).drop("_owner")
    sweeps = log.where("action = 'read_all'").withColumn("notification_id", F.lit(None).cast("bigint"))
    return own.unionByName(sweeps)


register(
    "CDC-2",
    lambda t: text_of(alerts.fold_read_state(_read_log(t), notifications=t("notifications")), "read_at"),
    """with log as (select epoch_us(r.at) as seq, r.user_id + 10 * (r.seq % 4) as user_id, r.notification_id, r.at as time_, r.action from read_log r),
       acts as (select l.seq, l.time_, l.action, n.user_id, n.notification_id from log l join notifications n on l.notification_id = n.notification_id and l.action <> 'read_all'
                union all select seq, time_, action, user_id, null from log where action = 'read_all'),
       state as (select n.user_id, n.notification_id, n.created_at, n.read_at, max(a.seq) filter (a.action = 'unread') as unread_seq
           from notifications n left join acts a on a.user_id = n.user_id and a.notification_id = n.notification_id group by 1, 2, 3, 4),
       own as (select s.user_id, s.notification_id, a.seq, a.time_ from state s join acts a
           on a.user_id = s.user_id and a.notification_id = s.notification_id and a.action = 'read' and a.seq > coalesce(s.unread_seq, -1)),
       swept as (select s.user_id, s.notification_id, min(a.seq) as seq from state s join acts a on a.user_id = s.user_id and a.action = 'read_all'
           and a.seq > coalesce(s.unread_seq, -1) and a.time_ >= s.created_at group by 1, 2),
       hits as (select * from own union all select w.user_id, w.notification_id, w.seq, a.time_ from swept w join acts a on a.seq = w.seq)
       select s.user_id, s.notification_id, cast(case when s.unread_seq is null and s.read_at is not null then s.read_at else f.time_ end as varchar) as read_at
       from state s left join (select user_id, notification_id, arg_min(time_, seq) as time_ from hits group by 1, 2) f
         on f.user_id = s.user_id and f.notification_id = s.notification_id""",
    "read_log",
    "notifications",
)


def _search_audit(t):
    now_rows = t("searches").select("search_id", "user_id", "name", "active")
    before = now_rows.where("search_id % 6 <> 1").withColumn(
        "active", F.when(F.col("search_id") % 4 == 1, ~F.col("active")).otherwise(F.col("active"))
    )
    return qualification.search_audit(before, now_rows.where("search_id % 6 <> 2"))


register(
    "CDC-3.searches",
    _search_audit,
    """select user_id, 'search.' || verb as action, 'saved_search' as target_type, cast(search_id as varchar) as target_id,
              'Recherche « ' || name || ' » ' || word || '.' as summary
       from (select *, case when search_id % 6 = 1 then 'create' when search_id % 6 = 2 then 'delete' when search_id % 4 = 1 then 'toggle' end as verb,
                    case when search_id % 6 = 1 then 'créée' when search_id % 6 = 2 then 'supprimée' when active then 'activée' else 'désactivée' end as word
             from searches) s where verb is not null""",
    "searches",
)
register(
    "CDC-3.statuses",
    lambda t: qualification.status_audit(
        t("qualification_log").where("action = 'status'").withColumn("user_id", F.col("listing_id") % 9)
    ),
    """select listing_id % 9 as user_id, 'listing.status' as action, 'listing' as target_type, cast(listing_id as varchar) as target_id,
              'Statut → ' || status || '.' as summary from qualification_log where action = 'status'""",
    "qualification_log",
)
