"""SIM, CLU and SET-4: similarity, best matches and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import fold_sql, haversine_sql, register, squash_sql
from hearthmark.functions import images, text
from hearthmark.functions.geo import closeness, haversine_m
from hearthmark.operators import clusters, matching

STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def with_hashes(listings):
    """The matching operators take hashes as an array."""
    return listings.withColumn("phashes", F.when(F.col("phash").isNotNull(), F.array("phash"))).drop("phash")


def features_sql(listings: str = "listings") -> str:
    """CTEs words(id, w), grams(id, g), feat(...) of a listing view."""
    return f"""
    txt as (select *, regexp_replace(coalesce(title, '') || ' ' || coalesce(description, ''), '^\\s+|\\s+$', '', 'g') as full_text from {listings}),
    words as (select id, w from (select id, unnest(list_distinct(regexp_extract_all({fold_sql('full_text')}, '[a-z0-9]{{2,}}'))) as w from txt) x
              where w not in ({STOP_SQL})),
    padded as (select id, '  ' || {squash_sql(fold_sql('full_text'))} || ' ' as p from txt),
    chars as (select id, unnest(string_split(p, '')) as c, unnest(range(1, len(string_split(p, '')) + 1)) as i from padded),
    grams as (select distinct id, g from (select id, c || lead(c, 1) over w || lead(c, 2) over w as g from chars
              window w as (partition by id order by i)) x where g is not null),
    nw as (select id, count(*) as n from words group by 1),
    ng as (select id, count(*) as n from grams group by 1),
    feat as (select t.id, t.user_id, full_text = '' as blank, coalesce(nw.n, 0) as n_words, coalesce(ng.n, 0) as n_grams, price, surface_m2, rooms,
                    nullif(property_type, '') as kind, lat, lng, phash, nullif({squash_sql(fold_sql('contact_name'))}, '') as contact
             from txt t left join nw on nw.id = t.id left join ng on ng.id = t.id)"""


OVERLAP_SQL = """
    wo as (select p.a, p.b, count(*) as n from p join words x on x.id = p.a join words y on y.id = p.b and y.w = x.w group by 1, 2),
    go as (select p.a, p.b, count(*) as n from p join grams x on x.id = p.a join grams y on y.id = p.b and y.g = x.g group by 1, 2),
    sims as (
      select p.a, p.b, fa.user_id,
        case when fa.n_words = 0 and fb.n_words = 0 then 1.0::double when fa.n_words = 0 or fb.n_words = 0 then 0.0::double
             else coalesce(wo.n, 0) / (fa.n_words + fb.n_words - coalesce(wo.n, 0)) end as jac,
        2.0::double * coalesce(go.n, 0) / (fa.n_grams + fb.n_grams) as dice,
        fa.blank as blank_a, fb.blank as blank_b,
        case when fa.price = 0 and fb.price = 0 then 1.0::double else greatest(0, 1 - abs(fa.price - fb.price) / greatest(abs(fa.price), abs(fb.price))) end as s_price_raw,
        fa.price is not null and fb.price is not null as has_price,
        case when fa.surface_m2 = 0 and fb.surface_m2 = 0 then 1.0::double else greatest(0, 1 - abs(fa.surface_m2 - fb.surface_m2) / greatest(abs(fa.surface_m2), abs(fb.surface_m2))) end as s_surface_raw,
        fa.surface_m2 is not null and fb.surface_m2 is not null as has_surface,
        case abs(fa.rooms - fb.rooms) when 0 then 1.0::double when 1 then 0.5::double else 0.0::double end as s_rooms_raw,
        fa.rooms is not null and fb.rooms is not null as has_rooms,
        case when fa.kind = fb.kind then 1.0::double when fa.kind <> fb.kind then 0.0::double end as s_type,
        case when fa.lat is not null and fb.lat is not null then greatest(0, 1 - """ + haversine_sql("fa.lat", "fa.lng", "fb.lat", "fb.lng") + """ / 2000) end as s_geo,
        case when fa.phash is not null and fb.phash is not null then 1 - bit_count(xor(cast('0x' || fa.phash as ubigint), cast('0x' || fb.phash as ubigint))) / 64 end as s_image,
        case when fa.contact = fb.contact then 1.0::double when fa.contact <> fb.contact then 0.0::double end as s_contact
      from p join feat fa on fa.id = p.a join feat fb on fb.id = p.b
      left join wo on wo.a = p.a and wo.b = p.b left join go on go.a = p.a and go.b = p.b),
    full_sims as (
      select *, case when blank_a and blank_b then 1.0::double when blank_a or blank_b then 0.0::double else 0.6::double * jac + 0.4::double * dice end as s_text,
             case when has_price then s_price_raw end as s_price, case when has_surface then s_surface_raw end as s_surface,
             case when has_rooms then s_rooms_raw end as s_rooms from sims),
    weighed as (
      select *, 0.0::double + 0.3::double + case when s_price is null then 0.0::double else 0.12::double end + case when s_surface is null then 0.0::double else 0.12::double end
             + case when s_rooms is null then 0.0::double else 0.06::double end + case when s_type is null then 0.0::double else 0.06::double end
             + case when s_geo is null then 0.0::double else 0.18::double end + case when s_image is null then 0.0::double else 0.12::double end
             + case when s_contact is null then 0.0::double else 0.04::double end as w from full_sims),
    scored as (
      select *, cast(floor(0.3::double / w * s_text * 100 + coalesce(0.12::double / w * s_price * 100, 0) + coalesce(0.12::double / w * s_surface * 100, 0)
             + coalesce(0.06::double / w * s_rooms * 100, 0) + coalesce(0.06::double / w * s_type * 100, 0) + coalesce(0.18::double / w * s_geo * 100, 0)
             + coalesce(0.12::double / w * s_image * 100, 0) + coalesce(0.04::double / w * s_contact * 100, 0) + 0.5) as int) as score from weighed),
    bucketed as (
      select *, case when s_image >= 0.95 and (s_geo is null or s_geo >= 0.5) then 'doublon_exact' when score >= 92 then 'doublon_exact'
             when score >= 78 then 'probable_identique' when score >= 55 then 'similaire' else 'different' end as bucket from scored)"""

PAIR_SQL = "with " + features_sql() + ", p as (select a, b from pairs)," + OVERLAP_SQL


def _pair_sets(t):
    sets = t("listings").select("id", text.listing_text(F.col("title"), F.col("description")).alias("full")).select(
        "id", (F.col("full") == "").alias("blank"), text.token_set(F.col("full")).alias("words"), text.trigram_set(F.col("full")).alias("grams")
    )
    a = sets.select(*[F.col(c).alias(f"a_{c}") for c in sets.columns])
    b = sets.select(*[F.col(c).alias(f"b_{c}") for c in sets.columns])
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).withColumnsRenamed({"a_id": "a", "b_id": "b"})


register(
    "SIM-1",
    lambda t: t("documents").select(
        "doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens")
    ),
    f"""select doc_id, array_to_string(list_filter(regexp_extract_all({fold_sql('text')}, '[a-z0-9]{{2,}}'), lambda w: w not in ({STOP_SQL})), ' ') as tokens
        from documents""",
)
register(
    "SIM-2",
    lambda t: _pair_sets(t).select("a", "b", F.round(text.jaccard(F.col("a_words"), F.col("b_words")), 6).alias("jaccard")),
    PAIR_SQL + " select a, b, round(jac, 6) as jaccard from sims",
    "listings",
    "pairs",
)
register(
    "SIM-3",
    lambda t: _pair_sets(t).select("a", "b", F.round(text.dice(F.col("a_grams"), F.col("b_grams")), 6).alias("dice")),
    PAIR_SQL + " select a, b, round(dice, 6) as dice from sims",
    "listings",
    "pairs",
)
register(
    "SIM-4",
    lambda t: _pair_sets(t).select(
        "a",
        "b",
        F.round(
            text.text_similarity(
                F.col("a_blank"), F.col("b_blank"), text.jaccard(F.col("a_words"), F.col("b_words")), text.dice(F.col("a_grams"), F.col("b_grams"))
            ),
            6,
        ).alias("text_similarity"),
    ),
    PAIR_SQL + " select a, b, round(s_text, 6) as text_similarity from full_sims",
    "listings",
    "pairs",
)
register(
    "SET-4",
    lambda t: _pair_sets(t).select(
        "a",
        "b",
        F.size(F.array_intersect("a_words", "b_words")).cast("bigint").alias("common"),
        F.size(F.array_union("a_words", "b_words")).cast("bigint").alias("united"),
    ),
    PAIR_SQL
    + """ select p.a, p.b, coalesce(wo.n, 0) as common, fa.n_words + fb.n_words - coalesce(wo.n, 0) as united
          from p join feat fa on fa.id = p.a join feat fb on fb.id = p.b left join wo on wo.a = p.a and wo.b = p.b""",
    "listings",
    "pairs",
)


def _slim_pairs(t):
    rows = with_hashes(t("listings")).select("id", "lat", "lng", images.hash_codes(F.col("phashes")).alias("hashes"))
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).withColumnsRenamed({"a_id": "a", "b_id": "b"})


_SLIM_SQL = "with p as (select x.id as a, y.id as b, x.lat as la, x.lng as ga, y.lat as lb, y.lng as gb, x.phash as ha, y.phash as hb from listings x join listings y on y.id = x.id + 1) "
register(
    "SIM-5",
    lambda t: _slim_pairs(t).select(
        "a", "b", F.round(closeness(haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))), 6).alias("geo")
    ),
    _SLIM_SQL
    + f"select a, b, case when la is not null and lb is not null then round(greatest(0, 1 - {haversine_sql('la', 'ga', 'lb', 'gb')} / 2000), 6) end as geo from p",
    "listings",
)
register(
    "SIM-6",
    lambda t: _slim_pairs(t).select("a", "b", F.round(images.image_similarity(F.col("a_hashes"), F.col("b_hashes")), 6).alias("image")),
    _SLIM_SQL
    + """select a, b, case when ha is not null and hb is not null
           then round(1 - bit_count(xor(cast('0x' || ha as ubigint), cast('0x' || hb as ubigint))) / 64, 6) end as image from p""",
    "listings",
)


def _comparable(t):
    return matching.comparable(with_hashes(t("listings")))


register(
    "SIM-7",
    lambda t: matching.score_pairs(t("pairs"), _comparable(t), _comparable(t)).select(
        "a",
        "b",
        "score",
        "bucket",
        F.array_join(F.transform("factors", lambda f: F.concat(f["factor"], F.lit("="), F.floor(f["contribution"] * 10 + 0.5).cast("bigint").cast("string"))), ";").alias("factors"),
    ),
    PAIR_SQL
    + """ select a, b, score, bucket, concat_ws(';', """
    + ", ".join(
        f"case when {c} is not null then '{n}=' || cast(floor({w}::double / w * {c} * 100 * 10 + 0.5) as bigint) end"
        for n, c, w in (
            ("texte", "s_text", 0.3),
            ("prix", "s_price", 0.12),
            ("surface", "s_surface", 0.12),
            ("pièces", "s_rooms", 0.06),
            ("type", "s_type", 0.06),
            ("géo", "s_geo", 0.18),
            ("images", "s_image", 0.12),
            ("contact", "s_contact", 0.04),
        )
    )
    + ") as factors from bucketed",
    "listings",
    "pairs",
)
register(
    "TOP-2",
    lambda t: matching.score_pairs(t("pairs"), _comparable(t), _comparable(t)).select(
        "a",
        "b",
        F.array_join(
            F.transform(
                F.slice(
                    F.array_sort(F.transform("factors", lambda f, i: F.struct((-f["contribution"]).alias("c"), i.alias("i"), f["factor"].alias("n")))), 1, 2
                ),
                lambda f: f["n"],
            ),
            ",",
        ).alias("top"),
    ),
    PAIR_SQL
    + """, parts as ("""
    + " union all ".join(
        f"select a, b, {i} as i, '{n}' as n, floor({w}::double / w * {c} * 100 * 10 + 0.5) as c from weighed where {c} is not null"
        for i, (n, c, w) in enumerate(
            (
                ("texte", "s_text", 0.3),
                ("prix", "s_price", 0.12),
                ("surface", "s_surface", 0.12),
                ("pièces", "s_rooms", 0.06),
                ("type", "s_type", 0.06),
                ("géo", "s_geo", 0.18),
                ("images", "s_image", 0.12),
                ("contact", "s_contact", 0.04),
            )
        )
    )
    + """) select a, b, string_agg(n, ',' order by c desc, i) as top from (
            select *, row_number() over (partition by a, b order by c desc, i) as rn from parts) x where rn <= 2 group by 1, 2""",
    "listings",
    "pairs",
)


def best_of(t, mode="blocked"):
    known = with_hashes(t("existing"))
    new = with_hashes(t("incoming")).join(known.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")
    return matching.best_matches(new, known, scope=["user_id"], mode=mode)


BEST_SQL = (
    features_sql()
    + """, fresh as (select i.id, i.user_id from incoming i left join existing e on e.source_id = i.source_id and e.external_id = i.external_id where e.id is null),
    p as (select f.id as a, e.id as b from fresh f join existing e on e.user_id = f.user_id), """
    + OVERLAP_SQL
    + """, ranked as (select *, row_number() over (partition by a order by score desc, b) as rn from bucketed),
    best as (select a as id, b as with_id, score, bucket from ranked where rn = 1 and bucket in ('doublon_exact', 'probable_identique'))"""
)
register(
    "SIM-8",
    best_of,
    "with " + BEST_SQL + " select id, with_id, score, bucket from best",
    "listings",
    "incoming",
    "existing",
)
register(
    "SIM-9",
    lambda t: matching.canonical_edges(t("edges"), "seq").select("a", "b", "score", "bucket"),
    """select a, b, score, bucket from (select least(a, b) as a, greatest(a, b) as b, score, bucket,
         row_number() over (partition by least(a, b), greatest(a, b) order by seq desc) as rn from edges where a <> b) x where rn = 1""",
    "edges",
)
def _grays(t):
    """Luminance rows from the vectors: the right number of values, too few, or none at all."""
    gray = F.concat(F.col("embedding"), F.slice("embedding", F.lit(1), (F.lit(8) - F.col("vec_id") % 3).cast("int")))
    return t("embeddings").select("vec_id", F.when(F.col("vec_id") % 10 != 9, gray).alias("gray"))


register(
    "SIM-10",
    lambda t: _grays(t).select("vec_id", images.dhash(F.col("gray")).alias("phash")),
    """select vec_id, case when len(g) = 72 then lower(printf('%016x', list_reduce(list_prepend(0::ubigint, list_transform(range(0, 64),
              lambda i: cast(case when g[9 * (i // 8) + i % 8 + 1] < g[9 * (i // 8) + i % 8 + 2] then 1 else 0 end as ubigint))), lambda x, y: x * 2 + y))) end as phash
       from (select vec_id, case when vec_id % 10 = 9 then null else list_concat(embedding, embedding[1:8 - vec_id % 3]) end as g from embeddings) e""",
)
register(
    "SIM-10.errors",
    lambda t: _grays(t).select("vec_id", images.dhash_error(F.col("gray")).alias("message")).where("message is not null"),
    f"select vec_id, '{images.GRAY_ERROR}' as message from embeddings where vec_id % 10 = 9 or vec_id % 3 <> 0",
)


def _clusters(t):
    edges = t("edges").select("a", "b", "score", "bucket")
    membership, summary = clusters.build_clusters(edges)
    return membership.join(summary, "component").select("node", "component", "members", "max_score", "kind")


CLUSTER_SQL = """
    kept as (select a, b, score, bucket from edges where score >= 78 and a <> b),
    twoway as (select a, b from kept union select b, a from kept),
    reach(node, other) as (select a, a from twoway union select r.node, b.b from reach r join twoway b on b.a = r.other),
    member as (select node, min(other) as component from reach group by 1)"""
register(
    "CLU-1",
    _clusters,
    "with recursive "
    + CLUSTER_SQL
    + """ select m.node, m.component, n.members, s.max_score, s.kind from member m
          join (select component, count(*) as members from member group by 1) n using (component)
          join (select component, max(score) as max_score,
                  case max(case bucket when 'doublon_exact' then 3 when 'probable_identique' then 2 else 1 end) when 3 then 'doublon_exact'
                    when 2 then 'probable_identique' else 'similaire' end as kind
                from kept join member on node = a group by 1) s using (component)""",
    "edges",
)


def _summaries(t):
    edges = t("edges").select("a", "b", "score", "bucket")
    return clusters.build_clusters(edges)[1].orderBy(F.desc("max_score"), "component")


register(
    "AGG-6",
    _summaries,
    "with recursive "
    + CLUSTER_SQL
    + """ select component, max(members) as members, max(score) as max_score,
                 case max(case bucket when 'doublon_exact' then 3 when 'probable_identique' then 2 else 1 end) when 3 then 'doublon_exact'
                   when 2 then 'probable_identique' else 'similaire' end as kind
          from kept join member on node = a join (select component, count(*) as members from member group by 1) n using (component) group by 1""",
    "edges",
)
