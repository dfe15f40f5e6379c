"""DuckDB SQL for the registered queries, written against the raw tables."""

from __future__ import annotations

from ..sources.files import QUEUE_TAG
from ..sources.tables import SQL

ORACLES: dict[str, str] = {}


def views(*names: str) -> str:
    return ", ".join(SQL[n] for n in names)


def near(q: str = "true", r: str = "true", on: str = "a.id <> b.id", name: str = "near") -> str:
    """Ranked neighbours of items where ``q`` among items where ``r``."""
    return f"""{name}_pairs as (select a.id, a.label, b.id nid, b.label nlabel, list_cosine_similarity(a.embedding, b.embedding) sim
        from (select * from items where {q}) a join (select * from items where {r}) b on {on}),
        {name} as (select *, row_number() over (partition by id order by round(sim, 9) desc, nid) rn from {name}_pairs)"""


def majority(k: int = 10, source: str = "near", name: str = "maj") -> str:
    return f"""{name}_votes as (select id, label, nlabel, count(*) votes from {source} where rn <= {k} group by all),
        {name} as (select id, label, nlabel majority, votes, n, own from (select *, row_number() over (partition by id order by votes desc, nlabel) r,
        sum(votes) over (partition by id) n, coalesce(sum(case when nlabel = label then votes end) over (partition by id), 0) own from {name}_votes) where r = 1)"""


def add(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = f"with recursive {', '.join(ctes)} {body}" if ctes else body


ITEMS = views("items")
CAND, GOLD = "role = 'candidate'", "role = 'golden'"
NEAR10 = near()
MAJ = majority()

add("knn_self", "select id, nid, rn as rank, round(sim, 6) sim from near where rn <= 10", ITEMS, NEAR10)
add("knn_per_class", "select id, round(avg(1 - sim), 6) knn_dist from near where rn <= 10 group by id", ITEMS, near(CAND, GOLD, "a.label = b.label"))
add("nearest_reference", "select id, nid, round(1 - sim, 6) distance from near where rn = 1", ITEMS, near(CAND, GOLD, "true"))
add("label_audit", "select id, label given_label, majority suggested_label, round((votes - own) / n, 6) disagreement from maj where majority <> label", ITEMS, NEAR10, MAJ)
add("class_distribution", "select label, count(*) n from items group by label", ITEMS)
PRED = "pred as (select i.id, i.label given, m.majority as pred, i.confidence conf from items i join maj m on m.id = i.id)"
CONF = "sure as (select p.* from pred p join (select pred, avg(conf) thr from pred group by pred) t on t.pred = p.pred where conf >= thr - 1e-9)"
JOINT = "joint as (select given, pred, count(*) n from sure group by all)"
add("confident_joint", "select * from joint", ITEMS, NEAR10, MAJ, PRED, CONF, JOINT)
add("noise_rates", "select given, pred, rate from (select given, pred, round(n / sum(n) over (partition by given), 4) rate from joint) where given <> pred", ITEMS, NEAR10, MAJ, PRED, CONF, JOINT)
add("confident_issues", "select id, given given_label, pred pred_label, round(conf, 6) confidence from sure where given <> pred", ITEMS, NEAR10, MAJ, PRED, CONF)
add("outlier_rank", "select id, round(avg(1 - sim), 6) outlier from near where rn <= 8 group by id", ITEMS, NEAR10)
add("class_pairs", "select distinct a.label a, b.label b from items a join items b on a.label < b.label", ITEMS)

MAPS = """ma as (select n_nationkey cid, n_name as name from nation), mb as (select n_nationkey + 100 cid, n_name as name from nation where n_nationkey % 2 = 0
    union all select r_regionkey + 200, r_name from region)"""
add("align_class_maps", """select name, cast(dense_rank() over (order by name) - 1 as bigint) new_id, cast(id_a as bigint) id_a, cast(id_b as bigint) id_b,
    case when id_a is null then 'only_b' when id_b is null then 'only_a' else 'common' end side
    from (select coalesce(ma.name, mb.name) as name, ma.cid id_a, mb.cid id_b from ma full join mb on ma.name = mb.name)""", MAPS)
add("class_name_sets", """select name, 'common' side from (select name from ma intersect select name from mb) union all select name, 'only_a' from (select name from ma except select name from mb)
    union all select name, 'only_b' from (select name from mb except select name from ma)""", MAPS)
TO = "case label when 'c1' then 'c0' when 'c3' then 'c0' when 'c5' then 'five' else label end"
add("relabel_items", f"select id, {TO} as label from items", ITEMS)
add("migration_diff", f'select label "old", {TO} "new", count(*) n from items where label <> {TO} group by all', ITEMS)
add("rollback_items", "select id, label from items", ITEMS)
add("merged_distribution", f"select {TO} as label, count(*) n from items where role in ('golden', 'candidate') group by 1", ITEMS)

# calibration and routing
THR = f"""{near(GOLD, GOLD, "a.id <> b.id and a.label = b.label", "own")}, own_d as (select id, avg(1 - sim) kd from own where rn <= 10 group by id),
    thr as (select i.label, quantile_cont(i.confidence, 0.05) conf_thr, quantile_cont(coalesce(o.kd, cast(0 as double)), 0.95) dist_thr, count(*) n_support
    from items i left join own_d o on o.id = i.id where {GOLD} group by i.label)"""
SCORED = f"""{near(CAND, GOLD, "a.label = b.label", "ref")}, ref_d as (select id, avg(1 - sim) kd from ref where rn <= 10 group by id),
    sup as (select label, count(*) n_ref from items where {GOLD} group by label),
    scored as (select i.*, coalesce(r.kd, cast('inf' as double)) knn_dist, coalesce(s.n_ref, 0) < 10 low_support from items i left join ref_d r on r.id = i.id left join sup s on s.label = i.label where {CAND})"""
ROUTED = """routed as (select s.*, t.conf_thr, t.dist_thr, t.n_support, list_filter([case when s.confidence < t.conf_thr then 'low_conf' end,
    case when t.n_support is null or s.knn_dist > t.dist_thr then 'far_from_known' end, case when s.low_support then 'low_support' end], lambda x: x is not null) reasons
    from scored s left join thr t on t.label = s.label)"""
IMG = "concat('img', cast(cast(floor(id / 20) as bigint) as varchar))"
add("calibrate", "select label, round(conf_thr, 6) conf_thr, round(dist_thr, 6) dist_thr, n_support from thr", ITEMS, THR)
add("set_threshold", "select label, case when label = 'c3' then 0.5 else round(conf_thr, 6) end conf_thr, case when label = 'c3' then 0.75 else round(dist_thr, 6) end dist_thr, n_support from thr", ITEMS, THR)
add("route_detections", "select id, case when len(reasons) > 0 then 'review' else 'pass' end decision, array_to_string(reasons, ',') reasons, round(knn_dist, 6) knn_dist from routed", ITEMS, THR, SCORED, ROUTED)
add("score_images", f"select {IMG} hash, round(max(confidence), 6) conf_max, round(max(knn_dist), 6) knn_dist from scored group by 1", ITEMS, SCORED)
RIMG = f"""imgs as (select distinct {IMG} hash from items union all select 'empty'), per as (select {IMG} hash, list_sort(list_distinct(flatten(list(reasons)))) reasons from routed group by 1),
    rimg as (select i.hash, case when p.hash is null then ['no_detection'] else p.reasons end reasons from imgs i left join per p on p.hash = i.hash)"""
add("route_images", "select hash, case when len(reasons) > 0 then 'review' else 'pass' end decision, array_to_string(reasons, ',') reasons from rimg", ITEMS, THR, SCORED, ROUTED, RIMG)
add("flag_rate", """select n, n_review, round(n_review / n, 6) flag_rate, case when n_review / n > 0.8 then 'too_many' when n_review / n < 0.05 then 'too_few' end warning
    from (select count(*) n, count(*) filter (where len(reasons) > 0) n_review from rimg)""", ITEMS, THR, SCORED, ROUTED, RIMG)
add("routing_diff", """select hash, was, now, case when was is null then 'added' when now is null then 'removed' else 'changed' end change from (
    select coalesce(a.hash, b.hash) hash, a.d was, b.d now from (select image_hash hash, max_by(decision, seq) d from r where seq <= h group by 1) a
    full join (select image_hash hash, max_by(decision, seq) d from r where seq > h group by 1) b on a.hash = b.hash) where was is null or now is null or was <> now""",
    views("ledger"), "r0 as (select * from ledger where event = 'route')", "r as (select *, (select floor(max(seq) / 2) from r0) h from r0)")
add("explain_detections", """select id, label, round(confidence, 6) confidence, round(conf_thr, 6) conf_thr, round(confidence - conf_thr, 6) conf_margin, round(knn_dist, 6) knn_dist, round(dist_thr, 6) dist_thr,
    round(dist_thr - knn_dist, 6) dist_margin, coalesce(n_support, 0) n_support from routed""", ITEMS, THR, SCORED, ROUTED)
SAY = {"low_conf": "the detector is less sure than usual for this class", "far_from_known": "the crop looks unlike the confirmed samples of its class", "low_support": "the class has too few confirmed samples to judge by", "no_detection": "nothing was detected in this image"}
SAYS = "case x " + " ".join(f"when '{k}' then '{v}'" for k, v in SAY.items()) + " else x end"
add("explain_reasons", f"select hash, case when len(reasons) = 0 then 'nothing unusual' else array_to_string(list_transform(reasons, lambda x: {SAYS}), '; ') end sentence from rimg", ITEMS, THR, SCORED, ROUTED, RIMG)


# near duplicates
def comps(where: str, distance: float, name: str = "comp", source: str = "items") -> str:
    return f"""{name}_e as (select a.id a, b.id b from {source} a join {source} b on a.id <> b.id where {where} and 1 - list_cosine_similarity(a.embedding, b.embedding) < {distance}),
        {name}_r(a, r) as (select distinct a, a from {name}_e union select e.b, c.r from {name}_r c join {name}_e e on e.a = c.a),
        {name} as (select a id, min(r) group_id from {name}_r group by a)"""


DUP = comps("true", 0.55)
add("dedup_groups", "select id, group_id from comp", ITEMS, DUP)
add("lsh_links", "select i.id, coalesce(c.group_id, i.id) class_id, (select count(*) from comp_e e where e.a = i.id) links from items i left join comp c on c.id = i.id", ITEMS, DUP)
add("dedup_conflicts", "select group_id, count(*) n, count(distinct label) n_labels from comp join items using (id) group by group_id having count(distinct label) > 1", ITEMS, DUP)
add("split_leakage", "select group_id, count(*) n, array_to_string(list_sort(list_distinct(list(split))), ',') splits from comp join items using (id) group by group_id having count(distinct split) > 1", ITEMS, DUP)
add("new_classes", """select n.id, round(n.distance, 6) distance, coalesce(c.group_id, n.id) as cluster, count(*) over (partition by coalesce(c.group_id, n.id)) as size,
    count(*) over (partition by coalesce(c.group_id, n.id)) >= 3 suggested from novel n left join comp c on c.id = n.id""",
    ITEMS, near(CAND, GOLD, "true"), "novel as (select n.id, 1 - n.sim distance, i.embedding from near n join items i on i.id = n.id where rn = 1 and 1 - sim > 0.63)", comps("true", 0.62, "comp", "novel"))
add("recycled_rows", "select id, nid, round(1 - sim, 6) distance from near where rn = 1 and 1 - sim <= 0.55", ITEMS, near(CAND, GOLD, "true"))
SIDE = lambda r, p: f"{near(r, r, 'a.id <> b.id', p + 'n')}, {majority(10, p + 'n', p + 'm')}, {comps(f'a.{r} and b.{r}', 0.55, p + 'c')}"
ONE = lambda n, r, p, rec: f"""select '{n}' as name, n, round((select count(*) from {p}m where majority <> label) / n, 6) label_noise, (select count(distinct group_id) from {p}c) dup_groups,
    (select count(*) - count(distinct group_id) from {p}c) redundant, {rec} recycled from (select count(*) n from items where {r})"""  # noqa: E731
add("compare_sets", ONE("a", GOLD, "g", "cast(null as bigint)") + " union all " + ONE("b", CAND, "k", "(select count(*) from near where rn = 1 and 1 - sim <= 0.55)"), ITEMS, SIDE(GOLD, "g"), SIDE(CAND, "k"), near(CAND, GOLD, "true"))

# coverage
COUNTS = f"cnt as (select label, count(*) n from items where {GOLD} group by label), med as (select quantile_cont(cast(n as double), 0.5) m from cnt)"
add("coverage_gaps", "select label, n, n < 0.5 * m under_represented, cast(case when n < 0.5 * m then greatest(0, ceil(m) - n) else 0 end as bigint) need from cnt, med", ITEMS, COUNTS)
add("coverage_target", "select label, n, n < 25 under_represented, cast(case when n < 25 then greatest(0, 25 - n) else 0 end as bigint) need from cnt", ITEMS, COUNTS)
add("sparse_items", """select id, label, round(kd, 6) density from (select d.*, quantile_cont(kd, 0.9) over (partition by label) thr from d) where round(kd, 9) >= round(thr, 9)""", ITEMS, near(on="a.id <> b.id and a.label = b.label"), "d as (select id, label, avg(1 - sim) kd from near where rn <= 5 group by all)")
add("coverage_delta", "select count(*) n, count(*) filter (where 1 - sim > 0.63) novel, round(count(*) filter (where 1 - sim > 0.63) / count(*), 6) novel_fraction from near where rn = 1", ITEMS, near(CAND, GOLD, "true"))
ISSUES = "iss as (select id from maj where majority <> label)"
add("review_queue", """select id, round(0.4 * unc + 0.4 * nov + 0.2 * wrong, 6) risk, array_to_string(list_filter([case when unc >= 0.5 then 'low_conf' end, case when nov >= 0.5 then 'far_from_known' end,
    case when wrong = 1 then 'suspected_label_error' end], lambda x: x is not null), ',') reasons, round(1 - unc, 6) conf, round(kd, 6) knn_dist from (
    select i.id, 1 - i.confidence unc, kd, least(1, kd / 0.5) nov, case when s.id is null then 0 else 1 end wrong from items i join (select id, avg(1 - sim) kd from ref where rn <= 10 group by id) r on r.id = i.id left join iss s on s.id = i.id)""",
    ITEMS, near(CAND, GOLD, "true", "ref"), NEAR10, MAJ, ISSUES)
add("harmful_ranking", """select id, round(harm, 6) harm, reasons from (select i.id, 0.5 * (s.id is not null)::int + 0.25 * (c.id is not null)::int + 0.25 * o.kd harm,
    array_to_string(list_filter([case when s.id is not null then 'suspected_label_error' end, case when c.id is not null then 'duplicate' end, case when o.kd > 0.5 then 'outlier' end], lambda x: x is not null), ',') reasons
    from items i join (select id, avg(1 - sim) kd from near where rn <= 5 group by id) o on o.id = i.id left join iss s on s.id = i.id left join comp c on c.id = i.id) order by round(harm, 9) desc, id limit 50""", ITEMS, NEAR10, MAJ, ISSUES, DUP)
add("overturns", """select id, label pred_class, round(confidence, 4) conf, round(knn_dist, 4) knn_dist, round(dist_thr, 4) dist_thr, round(confidence * (least(knn_dist, 2) - dist_thr) / (dist_thr + 1e-9), 4) wrongness
    from routed where confidence >= conf_thr and dist_thr > 0 and knn_dist > dist_thr order by wrongness desc, id limit 50""", ITEMS, THR, SCORED, ROUTED)
add("error_mine", "select id, nid error_id, round(sim, 6) similarity from near where rn = 1 order by round(sim, 9) desc, id limit 50", ITEMS, near(CAND, "role = 'anchor'", "true"))


# drift
def centroid(where: str, name: str, by: str = "label", unit: bool = False) -> str:
    v = "list_transform(embedding, lambda x: x / (sqrt(list_inner_product(embedding, embedding)) + 1e-12))" if unit else "embedding"
    return f"""{name}_f as (select {by} k, generate_subscripts(v, 1) - 1 pos, unnest(v) x from (select *, {v} v from items where {where})), {name}_m as (select k, pos, avg(x) x from {name}_f group by all),
        {name} as (select k, list(x order by pos) c from {name}_m group by k)"""


COS = "1 - list_cosine_similarity(a.c, b.c)"
add("class_centroids", "select m.k as label, cast(m.pos as bigint) pos, round(m.x / (sqrt(list_inner_product(c.c, c.c)) + 1e-12), 6) x from ce_m m join ce c on c.k = m.k", ITEMS, centroid("true", "ce"))
add("centroid_shift", f"select a.k as label, round({COS}, 6) shift from a join b on a.k = b.k", ITEMS, centroid("role = 'anchor'", "a"), centroid(CAND, "b"))


def consistency(q: str, r: str, name: str) -> str:
    return f"""{near(q, r, "true", name + "n")}, {name}_s as (select *, max(case when rn = 1 then sim end) over (partition by id) > 0.99999 skip from {name}n),
        {name}_v as (select id, label, nlabel, count(*) votes from {name}_s where rn > skip::int and rn <= 10 + skip::int group by all),
        {name} as (select coalesce(avg((nlabel = label)::int), 1) c from (select *, row_number() over (partition by id order by votes desc, nlabel) r from {name}_v) where r = 1)"""


add("label_consistency", "select round(c, 6) consistency from q", ITEMS, consistency(CAND, "role = 'anchor'", "q"))
add("drift_guard", f"""select round(ms, 6) max_shift, round(b0, 6) baseline, round(c1, 6) consistency, round(b0 - c1, 6) as "drop", ms > 0.15 or b0 - c1 > 0.05 triggered,
    array_to_string(list_filter([case when ms > 0.15 then 'centroid_shift' end, case when b0 - c1 > 0.05 then 'consistency_drop' end], lambda x: x is not null), ',') reasons
    from (select (select max({COS}) from a join b on a.k = b.k) ms, (select c from base) b0, (select c from q) c1)""",
    ITEMS, centroid("role = 'anchor'", "a"), centroid(CAND, "b"), consistency("role = 'anchor'", GOLD, "base"), consistency(CAND, "role = 'anchor'", "q"))
EARLY, LATE = "batch in ('w0', 'w1', 'w2', 'w3')", "batch in ('w4', 'w5', 'w6', 'w7')"
add("cross_period_drift", f"select a.k as label, round({COS}, 6) shift, {COS} > 0.15 alert from a join b on a.k = b.k", ITEMS, centroid(EARLY, "a", unit=True), centroid(LATE, "b", unit=True))
add("drift_representatives", f"""select label, id, rank, round(d, 6) distance from (select i.label, i.id, d, row_number() over (partition by i.label order by round(d, 9) desc, i.id) as rank
    from (select i.*, 1 - list_cosine_similarity(i.embedding, a.c) d from items i join a on a.k = i.label where {LATE}) i) where rank <= 3""", ITEMS, centroid(EARLY, "a", unit=True))
add("drift_type", f"""select round(cov, 4) covariate_shift, round(js, 4) prediction_shift, case when cov > 0.15 and js > 0.05 then 'both' when cov > 0.15 then 'covariate' when js > 0.05 then 'concept' else 'none' end verdict
    from (select (select {COS} from a, b) cov, (select sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) from norm) js)""", ITEMS, centroid("batch = 'w0'", "a", "1"), centroid("batch = 'w5'", "b", "1"),
    """mix as (select label, count(*) filter (where batch = 'w0') / (select count(*) from items where batch = 'w0') + 1e-12 p, count(*) filter (where batch = 'w5') / (select count(*) from items where batch = 'w5') + 1e-12 q
    from items where batch in ('w0', 'w5') group by label)""", "norm as (select p / sum(p) over () p, q / sum(q) over () q from mix)")
BOXES = views("items", "boxes")
STAT = ", ".join(f"round(avg({c}), 6) {c}_mean, round(quantile_cont({c}, 0.05), 6) {c}_p05, round(quantile_cont({c}, 0.95), 6) {c}_p95" for c in ("w", "h", "aspect"))
add("geometry_stats", f"select label, count(*) n, {STAT} from (select *, w / greatest(h, 1e-9) aspect from boxes) group by label", BOXES)
GEO = lambda r: f"(select avg(w) w_mean, avg(h) h_mean, avg(w / greatest(h, 1e-9)) aspect_mean, quantile_cont(w, 0.95) w_p95, quantile_cont(h, 0.95) h_p95 from boxes where {r})"
add("geometry_drift", "select round(w_mean, 6) w_mean, round(h_mean, 6) h_mean, round(aspect_mean, 6) aspect_mean, round(w_p95, 6) w_p95, round(h_p95, 6) h_p95, greatest(w_mean, h_mean, aspect_mean, w_p95, h_p95) > 0.2 alert from (select "
    + ", ".join(f"abs(a.{c} - b.{c}) {c}" for c in ("w_mean", "h_mean", "aspect_mean", "w_p95", "h_p95")) + f" from {GEO(GOLD)} a, {GEO(CAND)} b)", BOXES)
add("parity", """select grp, round(v, 6) as value, round(rel, 4) rel_to_median, n, n < 3 low_confidence, rel < -0.1 and n >= 3 worse from (select g.*, (v - m) / m rel from g, (select coalesce(quantile_cont(v, 0.5) filter (where n >= 3), quantile_cont(v, 0.5)) m from g))""",
    ITEMS, "g as (select concat(fab, '/', label) grp, avg(confidence) v, count(*) n from items group by 1)")
add("quality_trend", """select label, batch, round(m, 6) mean_conf, round(d, 6) as "drop", n, coalesce(d > 0.15, false) alert from (select label, batch, m, coalesce(n, 0) n, lag(m) over (partition by label order by batch) - m d from
    (select l.label, b.batch, c.m, c.n from (select distinct label from x) l cross join (select distinct batch from x) b left join (select label, batch, avg(confidence) m, count(*) n from x group by all) c on c.label = l.label and c.batch = b.batch))""",
    ITEMS, "x as (select * from items where not (label = 'c2' and batch = 'w3'))")


# detection evaluation: the greedy fold is a recursion over the predictions of an image and class
def iou(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.cx + {a}.w * 0.5, {b}.cx + {b}.w * 0.5) - greatest({a}.cx + {a}.w * -0.5, {b}.cx + {b}.w * -0.5))"
    h = f"greatest(0, least({a}.cy + {a}.h * 0.5, {b}.cy + {b}.h * 0.5) - greatest({a}.cy + {a}.h * -0.5, {b}.cy + {b}.h * -0.5))"
    return f"(({w}) * ({h}) / ({a}.w * {a}.h + {b}.w * {b}.h - ({w}) * ({h})))"


def matching(*thrs: float) -> str:
    t = ", ".join(f"({x})" for x in thrs)
    return f"""thrs(thr) as (select cast(t as double) from (values {t}) v(t)), po as (select p.*, t.thr, row_number() over (partition by p.image_id, p.label, t.thr order by p.conf desc, p.pred_id) o from eval_pred p, thrs t),
        step(image_id, label, thr, o, used, pred_id, conf, gt_id) as (
            select image_id, label, thr, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as double), cast(null as bigint) from po where o = 1
            union all
            select s.image_id, s.label, s.thr, p.o, case when g.gt_id is null then s.used else list_append(s.used, g.gt_id) end, p.pred_id, p.conf, g.gt_id
            from step s join po p on p.image_id = s.image_id and p.label = s.label and p.thr = s.thr and p.o = s.o + 1
            left join lateral (select arg_max(g.gt_id, (round({iou("p", "g")}, 12), g.gt_id)) gt_id from eval_gt g where g.image_id = p.image_id and g.label = p.label and not list_contains(s.used, g.gt_id) and {iou("p", "g")} >= p.thr) g on true),
        m as (select image_id, label, thr, pred_id, conf, gt_id from step where o > 0)"""


EVAL = views("eval_gt", "eval_pred")
M5, M57 = matching(0.5), matching(0.5, 0.75)
AP = """ng as (select label, count(*) n_gt from eval_gt group by label), pts as (select m.thr, m.label, coalesce(n_gt, 0) n_gt, row_number() over w rn, sum((gt_id is not null)::int) over w tp
    from m left join ng on ng.label = m.label window w as (partition by m.thr, m.label order by conf desc, pred_id)),
    env as (select *, case when n_gt > 0 then tp / n_gt else 0 end recall, max(tp / rn) over (partition by thr, label order by rn rows between current row and unbounded following) e from pts),
    aps as (select thr, label, round(sum(e * d), 4) ap, count(*) n_pred from (select *, recall - lag(recall, 1, 0) over (partition by thr, label order by rn) d from env) group by all),
    ap as (select coalesce(g.thr, a.thr) thr, coalesce(g.label, a.label) as label, coalesce(n_gt, 0) n_gt, coalesce(n_pred, 0) n_pred, coalesce(ap, 0) ap from (select * from ng, (select distinct thr from m)) g full join aps a on a.thr = g.thr and a.label = g.label)"""
MISS = "miss as (select g.* from eval_gt g where not exists (select 1 from m where m.image_id = g.image_id and m.gt_id = g.gt_id))"
add("match_boxes", "select image_id, label, pred_id, gt_id, round(conf, 6) conf from m", EVAL, M5)
add("average_precision", "select * from ap", EVAL, M57, AP)
add("mean_ap", "select thr, count(*) n_classes, round(avg(ap), 4) as map from ap group by thr", EVAL, M57, AP)
add("loc_gap", "select round(max(case when thr = 0.5 then x end) - max(case when thr = 0.75 then x end), 4) loc_gap from (select thr, round(avg(ap), 4) x from ap group by thr)", EVAL, M57, AP)
add("false_negatives", f"""select g.image_id, g.gt_id, g.label, case when max((p.label <> g.label and {iou('p', 'g')} >= 0.5)::int) = 1 then 'classification' when max((p.label = g.label and {iou('p', 'g')} >= 0.1 and {iou('p', 'g')} < 0.5)::int) = 1 then 'localization' else 'missed' end as type
    from miss g left join eval_pred p on p.image_id = g.image_id group by all""", EVAL, M5, MISS)
FP = f"""fp as (select m.image_id, m.pred_id, m.label pl, m.conf, g.gt_id, g.label gl, {iou('p', 'g')} v from m join eval_pred p on p.pred_id = m.pred_id left join miss g on g.image_id = m.image_id where m.gt_id is null)"""
FPS = "fps as (select image_id, pred_id, pl as label, round(conf, 4) conf, case when coalesce(max(((gl <> pl and v >= 0.5) or (gl = pl and v >= 0.1 and v < 0.5))::int), 0) = 1 then 'paired' else 'background' end as type from fp group by image_id, pred_id, pl, conf)"
CM = "cm as (select truth, pl as pred, count(*) n from (select image_id, pred_id, pl, arg_min(gl, gt_id) truth from fp where gl <> pl and v >= 0.5 group by all) group by truth, pl)"
add("false_positives", "select * from fps", EVAL, M5, MISS, FP, FPS)
add("confusion", "select * from cm", EVAL, M5, MISS, FP, CM)
add("eval_per_image", """select i.image_id, coalesce(a.n, 0) n_fp, coalesce(b.n, 0) n_fn from (select image_id from eval_gt union select image_id from m) i left join (select image_id, count(*) n from m where gt_id is null group by 1) a on a.image_id = i.image_id
    left join (select image_id, count(*) n from miss group by 1) b on b.image_id = i.image_id""", EVAL, M5, MISS)
add("confident_false_positives", "select image_id, pred_id, label pred_class, conf from fps where type = 'background' order by conf desc, image_id, pred_id limit 50", EVAL, M5, MISS, FP, FPS)
add("diagnose_errors", f"""select image_id, gt_id, case when coalesce(v, 0) < 0.1 then 'missed' when v >= 0.5 then case when pl = label then 'ok' else 'classification_error' end else 'localization_error' end verdict from (
    select g.image_id, g.gt_id, g.label, p.label pl, {iou('p', 'g')} v, row_number() over (partition by g.image_id, g.gt_id order by {iou('p', 'g')} desc nulls last, p.pred_id) r from eval_gt g left join eval_pred p on p.image_id = g.image_id) where r = 1""", EVAL)
add("eval_set_hash", """select substr(sha256(array_to_string(list_sort(list(concat(b, s))), '|')), 1, 16) hash from (select b, sha256(array_to_string(list_sort(list(x)), '|')) s from (
    select concat(image_id, ':', d) x, substr(d, 1, 2) b from (select image_id, sha256(array_to_string(list_sort(list(concat_ws(',', label, printf('%.6f', cx), printf('%.6f', cy), printf('%.6f', w), printf('%.6f', h)))), '|')) d from eval_gt group by 1)) group by b)""", views("eval_gt"))
add("regression_check", """select 'blocking' kind, cast(null as varchar) as label, 'map_drop' reason, round(d, 6) as "drop" from (select round(round(avg(was), 4) - round(avg(ap), 4), 4) d from j) where d > 0.02
    union all select 'blocking', label, case when n < 20 then 'protected_support' else 'protected_drop' end, case when n >= 20 then round(was - ap, 4) end from j where label in ('click', 'view', 'error') and (n < 20 or round(was - ap, 4) > 0.05)
    union all select 'advisory', label, 'small_support', null from j where label not in ('click', 'view', 'error') and n < 20""", EVAL, M5, AP,
    "j as (select label, ap, case when label = 'click' then ap + 0.2 else ap end was, case when label = 'view' then 5 else n_gt end n from ap)")
add("weakness_health", """select round(avg(ap), 4) as map, min(ap) worst_ap, (select count(*) from fps where type = 'background' and conf >= 0.8) n_confident_wrong, case when round(avg(ap), 4) < 0.3 or min(ap) < 0.1 then 'RED'
    when round(avg(ap), 4) < 0.6 or min(ap) < 0.4 or (select count(*) from fps where type = 'background' and conf >= 0.8) > 0 then 'AMBER' else 'GREEN' end health from ap""", EVAL, M5, AP, MISS, FP, FPS)
FNS = f"fns as (select g.gt_id, g.label, case when max((p.label <> g.label and {iou('p', 'g')} >= 0.5)::int) = 1 then 'classification' when max((p.label = g.label and {iou('p', 'g')} >= 0.1 and {iou('p', 'g')} < 0.5)::int) = 1 then 'localization' else 'missed' end as type from miss g left join eval_pred p on p.image_id = g.image_id group by all)"
add("weakest_classes", """select a.label, a.ap, k.dominant_fn, k.n_fn, c.confused_with from ap a left join (select label, arg_max(type, (k, type)) dominant_fn, cast(sum(k) as bigint) n_fn from (select label, type, count(*) k from fns group by all) group by label) k on k.label = a.label
    left join (select truth, arg_max(pred, (n, pred)) confused_with from cm group by truth) c on c.truth = a.label""", EVAL, M5, AP, MISS, FNS, FP, CM)

# boxes
QA = """select b.id, b.label, case when w * h < 1e-4 or w < 1e-3 or h < 1e-3 then 'degenerate' when cx - w / 2 <= 1e-3 or cy - h / 2 <= 1e-3 or cx + w / 2 >= 1 - 1e-3 or cy + h / 2 >= 1 - 1e-3 then 'truncated'
    when w * h < a0 or w * h > a1 then 'area_outlier' when w / h < r0 or w / h > r1 then 'aspect_outlier' end issue from boxes b left join (select label, quantile_cont(w * h, 0.01) a0, quantile_cont(w * h, 0.99) a1,
    quantile_cont(w / h, 0.01) r0, quantile_cont(w / h, 0.99) r1 from boxes group by label having count(*) >= 8) e on e.label = b.label"""
add("box_qa", f"select id, label, issue, cast(list_position(['degenerate', 'truncated', 'area_outlier', 'aspect_outlier'], issue) - 1 as integer) severity from ({QA}) where issue is not null", BOXES)
add("box_tightness", f"select b.id, round({iou('b', 'm')}, 6) iou from boxes b join (select id, cx + 0.01 cx, cy, w * 0.8 w, h from boxes) m on m.id = b.id where {iou('b', 'm')} < 0.6", BOXES)
add("yolo_lines", "select cast(id as varchar) hash, printf('%d %.6f %.6f %.6f %.6f', cast(substr(label, 2) as integer), cx, cy, w, h) line from boxes where role = 'golden' and label <> 'c9'", BOXES)
add("unknown_classes", "select label, count(*) n from boxes where label >= 'c7' group by label", BOXES)
add("yolo_files", """select hash, case when nth = 0 then stem else concat(stem, '_', nth) end as name, case when row_number() over (order by path, hash) <= greatest(1, cast(floor(count(*) over () * 0.2) as integer)) then 'val' else 'train' end split, size from (
    select *, row_number() over (partition by stem order by path, hash) - 1 nth from (select cast(id % 40 as varchar) hash, concat('img_', (id % 40) % 7) stem, concat('/d', id % 40, '/img_', (id % 40) % 7, '.png') path,
    cast(sum(length(printf('%d %.6f %.6f %.6f %.6f', cast(substr(label, 2) as integer), cx, cy, w, h))) + count(*) - 1 as bigint) as size from boxes where role = 'golden' group by 1, 2, 3))""", BOXES)

# ledger
LED = views("ledger")
add("ledger_filter", "select seq, image_hash, decision from ledger where event = 'review' and reviewer_id = 'r1'", LED)
add("image_history", "select seq, event, decision from ledger where image_hash = 'u7'", LED)
add("fp_rate", "select count(*) reviews, count(*) filter (where decision = 'false_alarm') false_alarms, round(count(*) filter (where decision = 'false_alarm') / count(*), 4) fp_rate from ledger where event = 'review'", LED)
add("reasons_breakdown", """select reason, count(*) n from (select unnest(list_filter([case when seq % 2 = 0 then 'low_conf' end, case when seq % 3 = 0 then 'far_from_known' end, case when seq % 5 = 0 then 'low_support' end], lambda x: x is not null)) reason
    from ledger where event = 'route') group by reason""", LED)
add("throughput", """select count(*) filter (where h >= 0) resolved, count(*) filter (where t1 is null) as "open", round(quantile_cont(h, 0.5) filter (where h >= 0), 6) median_hours, round(quantile_cont(h, 0.9) filter (where h >= 0), 6) p90_hours from (
    select t1, (epoch_us(t1) - epoch_us(t0)) / 3.6e9 h from (select image_hash, min_by(ts, seq) t0 from ledger where event = 'route' and decision = 'review' group by 1) a left join (select image_hash, max_by(ts, seq) t1 from ledger where event = 'review' group by 1) b on a.image_hash = b.image_hash)""", LED)
add("review_rate", "select batch_id, count(*) n, round(avg((decision = 'review')::int), 6) review_rate from ledger where event = 'route' group by batch_id", LED)
add("latest_reasons", """select image_hash, case when len(r) > 0 then array_to_string(r, ',') else d end reasons from (select image_hash, max_by(decision, seq) d,
    max_by(list_filter([case when seq % 2 = 0 then 'low_conf' end, case when seq % 3 = 0 then 'far_from_known' end], lambda x: x is not null), seq) r from ledger where event = 'route' group by 1)""", LED)
add("queue_hit_rate", """select queue, arg_min(predict, seq) predict, cast(count(*) as bigint) emitted, count(outcome) resolved, cast(sum(hit) as bigint) hits, case when count(outcome) > 0 then round(sum(hit) / count(outcome), 3) end "precision",
    round(count(outcome) / count(*), 3) "coverage", count(outcome) < 5 insufficient from (select *, case when outcome is null then 0 when predict = 'wrong' then (outcome = 'rejected')::int when predict = 'defect' then (outcome = 'confirmed')::int else 1 end hit from (
    select e.queue, e.predict, e.seq, e.id, arg_min(r.outcome, r.seq) outcome from (select concat('q', seq % 3) queue, ['wrong', 'defect', 'label'][seq % 3 + 1] predict, seq, image_hash id from ledger where event = 'queue_emit') e
    left join (select image_hash id, case when decision = 'confirmed' then 'confirmed' else 'rejected' end outcome, seq from ledger where event = 'review') r on r.id = e.id and r.seq > e.seq group by all)) group by queue""", LED)
add("reviewer_audit", """select n.reviewer_id, n.n n_decisions, coalesce(p.k, 0) similar_pairs, coalesce(p.c, 0) conflicts, round(case when coalesce(p.k, 0) > 0 then 1 - p.c / p.k else 1 end, 6) intra_consistency, n.n < 10 insufficient from (select reviewer_id, count(*) n from d group by 1) n left join (
    select a.reviewer_id, count(*) k, count(*) filter (where a.decision <> b.decision) c from d a join d b on a.reviewer_id = b.reviewer_id and a.seq < b.seq where round(list_cosine_similarity(a.embedding, b.embedding), 9) >= 0.3 group by 1) p on p.reviewer_id = n.reviewer_id""",
    views("items", "ledger"), "d as (select l.reviewer_id, l.seq, l.decision, i.embedding from ledger l join items i on i.id = cast(substr(l.image_hash, 2) as bigint) where l.event = 'review')")
PTS = "pts as (select event_id seq, event_type as label, case when event_id % 150 <> 0 then round((event_id * 13 % 100) / cast(100 as double), 4) end ap, case when event_id > 100 then 'h2' else 'h1' end h from events)"
add("ap_trend", "select label, count(*) n_points, arg_min(ap, seq) first_ap, arg_max(ap, seq) last_ap, case when count(*) >= 2 then round(arg_max(ap, seq) - arg_min(ap, seq), 4) end delta from pts where ap is not null group by label", PTS)
add("eval_set_changed", "select count(distinct h) > 1 eval_set_changed from pts", PTS)
add("previous_eval", "select seq, image_hash from ledger where event = 'queue_emit' order by seq desc limit 1 offset 1", LED)
GATES = """g as (select seq, batch_id, case seq % 4 when 0 then 'batch_gate' when 1 then 'batch_admit' when 2 then case when seq % 5 = 0 then 'batch_unadmit' else 'other' end else 'other' end event,
    case when seq % 4 = 0 then case when seq % 3 = 0 then 'BLOCK' else 'PASS' end when seq % 7 = 0 then 'REFUSED' else 'OK' end decision from ledger)"""
BT = lambda refused: f"""select batch_id, arg_max(decision, seq) filter (where event = 'batch_gate') verdict, coalesce(arg_max(adm, seq) filter (where adm is not null), false) admitted, min(seq) filter (where event in ('batch_gate', 'batch_admit')) first_seq
    from (select *, case when event = 'batch_unadmit' then false when event = 'batch_admit' then case when decision = 'REFUSED' then {refused} else true end end adm from g) group by batch_id having min(seq) filter (where event in ('batch_gate', 'batch_admit')) is not null"""  # noqa: E731
add("batch_trend", BT("false"), LED, GATES)
add("batch_ledger", BT("null"), LED, GATES)
add("resolved_ids", "select distinct image_hash id from ledger where event = 'review'", LED)
add("truncation", "select count(*) n, count(*) < 10500 truncated from ledger", LED)

# monitoring
XS = "pt as (select event_type chart, cast(floor(event_id / 250) as bigint) t, round(avg(value), 4) x from events group by all), xs as (select *, row_number() over (partition by chart order by t) - 1 i from pt)"
EW = "ew(chart, i, z) as (select chart, i, x from xs where i = 0 union all select e.chart, x.i, 0.3 * x.x + 0.7 * e.z from ew e join xs x on x.chart = e.chart and x.i = e.i + 1)"
add("ewma", "select chart, i, round(z, 6) z from ew", XS, EW)


def cusum(target: str, k: str, h: str) -> str:
    up, down = f"greatest(0, c.p + (x.x - {target}) - {k})", f"greatest(0, c.n + ({target} - x.x) - {k})"
    return f"""cu(chart, i, p, n, a) as (select chart, cast(-1 as bigint), cast(0 as double), cast(0 as double), cast(null as bigint) from base union all
        select c.chart, x.i, {up}, {down}, case when {up} > {h} or {down} > {h} then x.i end from cu c join xs x on x.chart = c.chart and x.i = c.i + 1 join base b on b.chart = c.chart where c.a is null)"""


add("cusum", "select chart, round(arg_max(p, i), 6) s_pos, round(arg_max(n, i), 6) s_neg, max(a) alarm_index from cu group by chart", XS, "base as (select chart, x t0 from xs where i = 0)", cusum("b.t0", "1.0", "6.0"))
add("spc_monitor", """select b.chart, b.n, round(t0, 6) target, round(s, 6) sigma, (select min(i) from ew e where e.chart = b.chart and abs(e.z - t0) > 3 * s * sqrt(0.3 / 1.7)) ewma_index, (select max(a) from cu c where c.chart = b.chart) cusum_index, b.n < 8 short from base b""",
    XS, EW, "cnt as (select chart, count(*) n from xs group by 1)", "base as (select x.chart, c.n, quantile_cont(x.x, 0.5) t0, case when stddev_pop(x.x) > 0 then stddev_pop(x.x) else 1e-6 end s from xs x join cnt c on c.chart = x.chart where x.i < greatest(3, c.n // 4) group by all)", cusum("b.t0", "0.5 * b.s", "4 * b.s"))
CAL = views("calib")
CLIP = "greatest(1e-6, least(1 - 1e-6, conf))"
add("calibration_error", f"select round(sum(n * abs(c - y)) / sum(n), 6) ece from (select b, count(*) n, avg(c) c, avg(correct) y from (select {CLIP} c, correct, (select count(*) from range(1, 10) r(i) where {CLIP} > r.i * cast(0.1 as double)) b from calib) group by b)", CAL)
add("temperature_scaled", f"select doc_id, round(1 / (1 + exp(-ln({CLIP} / (1 - {CLIP})) / 1.7)), 6) conf from calib", CAL)
add("cost_gate", "select round(1.0 + r * 2, 4) expected_cost, 1.0::double miss_component, round(r * 2, 4) fa_component, case when 1.0 + r * 2 <= 1.8 then 'GO' else 'NO-GO' end verdict from (select round(count(*) filter (where decision = 'false_alarm') / count(*), 4) r from ledger where event = 'review')", LED)

# banks and gates
BANK = f"bk as (select id, label, embedding from items where {GOLD} and label in ('c0', 'c1', 'c2')), {near(GOLD, GOLD, 'a.id <> b.id and a.label = b.label', 'bn')}, bs as (select label bank, greatest(quantile_cont(kd, 0.5), 1e-3) scale from (select id, label, avg(1 - sim) kd from bn where rn <= 10 and label in ('c0', 'c1', 'c2') group by all) group by label)"
add("bank_scales", "select bank, round(scale, 6) scale from bs", ITEMS, BANK)
add("bank_audit", """select i.id, case when raw <= 0.9 and margin >= 0.004 then top else 'unknown' end verdict, case when raw <= 0.9 and margin >= 0.004 then top end winning_bank, round(margin, 6) margin, round(raw, 6) min_raw_dist from items i join (
    select id, max(case when r = 1 then bank end) top, round(max(case when r = 1 then s end) - max(case when r = 2 then s end), 4) margin, min(raw) raw from (select *, row_number() over (partition by id order by s desc, bank) r from (
    select q.id, q.nlabel bank, round(exp(-avg(1 - sim) / any_value(b.scale)), 4) s, round(avg(1 - sim), 4) raw from (select *, row_number() over (partition by id, nlabel order by round(sim, 9) desc, nid) k from q_pairs) q join bs b on b.bank = q.nlabel where k <= 10 group by q.id, q.nlabel)) group by id) v on v.id = i.id""",
    ITEMS, BANK, near(CAND, "role = 'golden' and label in ('c0', 'c1', 'c2')", "true", "q"))
add("wilson_intervals", """select reviewer_id, k, n, round(greatest(0, (p + z / (2 * n) - hw) / (1 + z / n)), 6) lo, round(least(1, (p + z / (2 * n) + hw) / (1 + z / n)), 6) hi, case when o % 2 = 1 then o else o + 1 end odd_k,
    case when k < 10 or n < 25 then 'insufficient_support' when k < 20 then 'provisional' else 'supported' end tier from (select *, 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n)) hw, greatest(3, cast(floor(sqrt(n)) as bigint)) o from (
    select reviewer_id, count(*) filter (where decision = 'confirmed') k, count(*) n, count(*) filter (where decision = 'confirmed') / count(*) p, cast(1.96 * 1.96 as double) z from ledger group by 1))""", LED)
add("batch_gate", f"""select i.batch, coalesce(b.n, 0) n_block, coalesce(c.n, 0) n_clean, case when coalesce(b.n, 0) > 0 then 'BLOCK' when i.batch = 'w3' then 'PARTIAL' when coalesce(c.n, 0) > 0 then 'CLEAN' else 'PASS' end verdict from (select distinct batch from items) i
    left join (select x.batch, count(*) n from ({QA}) q join boxes x on x.id = q.id where q.issue = 'degenerate' group by 1) b on b.batch = i.batch left join (select batch, count(*) n from items where confidence < 0.45 group by 1) c on c.batch = i.batch""", BOXES)
add("sample_status", """select n, n detected, n embedded, golden, review, n - review pass, cast(0 as bigint) rejected, case when n = 0 then 'ingest' when golden = 0 then 'confirm_golden' when review > 0 then 'review' else 'gate' end next_step from (
    select count(*) n, count(*) filter (where role = 'golden') golden, count(*) filter (where confidence < 0.5) review from items)""", ITEMS)
HEALTH = """h as (select *, redundant / n dup_rate, n_review / n review_ratio, n_issues / n label_rate from (select (select count(*) from items) n, (select count(*) from items where confidence < 0.5) n_review, (select count(*) - count(distinct group_id) from comp) redundant,
    (select count(*) from iss) n_issues, (select count(*) from (select label, count(*) k from items group by 1) c, (select quantile_cont(cast(k as double), 0.5) m from (select label, count(*) k from items group by 1)) where k < 0.5 * m) n_under))"""
add("health_report", "select n, n_review, redundant, n_issues, n_under, round(dup_rate, 6) dup_rate, round(review_ratio, 6) review_ratio, round(label_rate, 6) label_rate, greatest(0, round(100 - 30 * dup_rate - 30 * label_rate - 20 * review_ratio - 5 * n_under, 1)) quality from h", ITEMS, NEAR10, MAJ, ISSUES, DUP, HEALTH)
add("report_suggestions", "select kind, round(m, 6) magnitude from (select 'duplicates' kind, dup_rate m from h union all select 'label_errors', label_rate from h union all select 'open_review', review_ratio from h) where m > 0", ITEMS, NEAR10, MAJ, ISSUES, DUP, HEALTH)

# review and snapshots
SAMP = """samp as (select cast(id as varchar) hash, unnest([role, concat('batch:', batch), concat('fab:', fab)]) tag from items), ev as (select cast(cast(substr(image_hash, 2) as bigint) % 500 as varchar) hash,
    case when event = 'queue_emit' then concat('QUEUE_TAG', reviewer_id) when decision = 'confirmed' then 'golden' else 'rejected' end tag, case when seq % 6 = 0 then 'remove' else 'add' end op, seq from ledger where event in ('review', 'queue_emit')),
    fold as (select hash, tag, arg_max(op, seq) op from (select hash, tag, 'add' op, -1 seq from samp union all select * from ev) group by all), folded as (select hash, list_sort(list(tag)) tags from fold where op = 'add' group by hash)""".replace("QUEUE_TAG", QUEUE_TAG)
RV = views("items", "ledger")
add("fold_tags", "select s.hash, coalesce(array_to_string(f.tags, ','), '') tags from (select distinct hash from samp) s left join folded f on f.hash = s.hash", RV, SAMP)
add("worklists", f"select substr(tag, {len(QUEUE_TAG) + 1}) as name, count(*) n from fold where op = 'add' and starts_with(tag, '{QUEUE_TAG}') and hash in (select hash from samp) group by 1", RV, SAMP)
add("export_set", "select hash from folded where list_contains(tags, 'golden') and not list_contains(tags, 'rejected') and hash in (select hash from samp)", RV, SAMP)
add("tag_filter", "select cast(id as varchar) hash, fab from items where role in ('golden', 'anchor') and batch <> 'w2'", ITEMS)
add("sync_reviews", """select case d when 'false_alarm' then 'rejected' when 'confirmed' then 'confirmed' else 'relabel' end outcome, case when d = 'hardneg' then 'scratch' end as label, count(*) n from (select image_hash, max_by(decision, seq) d from ledger where event = 'review' group by 1) group by 1, 2""", LED)
add("snapshot_composition", "select role in ('golden', 'anchor') included, count(*) n from items group by 1", ITEMS)
add("snapshot_restore", "select cast(id as varchar) image_hash, case when role = 'candidate' then 'drop' else 'add' end as action from items where role in ('candidate', 'anchor')", ITEMS)
add("content_hash", "select sha256(array_to_string(list_sort(list(concat(b, s))), '|')) hash from (select substr(sha256(x), 1, 2) b, sha256(array_to_string(list_sort(list(x)), '|')) s from (select cast(id as varchar) x from items) group by 1)", ITEMS)
add("box_digests", "select concat('i', cast(floor(id / 5) as bigint)) image_hash, sha256(array_to_string(list_sort(list(concat_ws(',', label, cast(cast(floor(cx * 10000 + 0.5) as bigint) as varchar), cast(cast(floor(cy * 10000 + 0.5) as bigint) as varchar), cast(cast(floor(w * 10000 + 0.5) as bigint) as varchar), cast(cast(floor(h * 10000 + 0.5) as bigint) as varchar)))), '|')) digest from boxes group by 1", BOXES)
add("verify_files", """select case when doc_id % 23 = 0 and k = 1 then concat('f', doc_id, 'x') else concat('f', doc_id) end path, case when k = 1 then 'unexpected' when doc_id % 17 = 0 then 'missing' else 'mismatched' end problem
    from documents, (values (0), (1)) v(k) where (k = 1 and doc_id % 23 = 0) or (k = 0 and (doc_id % 17 = 0 or doc_id % 19 = 0))""")
add("synthetic_detections", "select hash, 'one' as label, round(cast(0.4 as double) + cast(0.6 as double) * (cast(concat('0x', substr(sha256(hash), 1, 8)) as bigint) % 1000) / 1000, 3) confidence from (select distinct sha256(text) hash from documents)")
add("ingest_batch", """select h image_hash, src_path from (select sha256(text) h, min(printf('/data/%08d.png', doc_id)) src_path from documents group by 1) where h not in (select sha256(text) from documents where doc_id % 10 = 0)""")
add("image_items", """select a.g as id, h.label, round(h.c, 6) confidence, round(a.t, 6) total from (select g, sum(x) t from (select g, pos, avg(x) x from (select cast(floor(id / 4) as bigint) g, generate_subscripts(embedding, 1) pos, unnest(embedding) x from items where id % 9 <> 0) group by all) group by g) a
    join (select cast(floor(id / 4) as bigint) g, arg_min(label, id) as label, max(confidence) c from items group by 1) h on h.g = a.g""", ITEMS)

# proposals, error regions, baselines, merges
add("confidence_band", "select id, round(confidence, 6) confidence from items where confidence >= 0.45 and confidence < 0.55", ITEMS)
STORED = "stored as (select cast(p.image_id as varchar) hash, p.pred_id pos, i.embedding, p.cx, p.cy, p.w, p.h from eval_pred p join items i on i.id = p.pred_id % 100 where p.pred_id % 3 <> 0)"
ERRORS = """errors as (select 'fn' kind, gt_id error_id, cast(image_id as varchar) hash, label, cx, cy, w, h, cast(0.1 as double) least from miss
    union all select 'fp', p.pred_id, cast(p.image_id as varchar), p.label, p.cx, p.cy, p.w, p.h, 0.5 from m join eval_pred p on p.pred_id = m.pred_id where m.gt_id is null)"""


def mined(which: str, fallback: bool) -> str:
    best = f"""best as (select e.hash, concat_ws(':', e.hash, e.kind, cast(e.error_id as varchar)) id, arg_max(s.embedding, ({iou("e", "s")}, s.pos)) embedding
        from errors e join stored s on s.hash = e.hash where {which} and {iou("e", "s")} >= e.least group by e.hash, e.kind, e.error_id)"""
    lost = """lost as (select hash, concat(hash, ':image') id, list(x order by k) embedding from (select hash, k, avg(x) x from (select s.hash, unnest(s.embedding) x, generate_subscripts(s.embedding, 1) k
        from stored s where s.hash in (select hash from errors) and s.hash not in (select hash from best)) group by hash, k) group by hash)"""
    regions = "regions as (select id, embedding from best" + (" union all select id, embedding from lost)" if fallback else ")")
    rank = """ranked as (select i.id, r.id region, list_cosine_similarity(i.embedding, r.embedding) sim, row_number() over (partition by i.id order by round(list_cosine_similarity(i.embedding, r.embedding), 9) desc, r.id) rn
        from items i, regions r where i.role = 'candidate')"""
    return ", ".join([best, lost, regions, rank])


MINED = "select cast(id as varchar) id, round(sim, 4) closeness, region from ranked where rn = 1 order by closeness desc, cast(id as varchar) limit 40"
add("error_mine_boxes", MINED, EVAL, ITEMS, M5, MISS, STORED, ERRORS, mined("true", True))
add("error_mine_class", MINED, EVAL, ITEMS, M5, MISS, STORED, ERRORS, mined("e.label = 'click'", False))
HASHED = "eh as (" + ORACLES["eval_set_hash"].split(views("eval_gt"), 1)[1].lstrip(" ,") + ")"
add("eval_baseline", """select label, ap, n_gt, case label when 'click' then cast(0.05 as double) when 'view' then 0.1 end allowed, (select round(avg(ap), 4) from ap) as map, (select hash from eh) eval_set_hash, cast(0.02 as double) map_drop from ap""", EVAL, M5, AP, HASHED)
ORACLES["baseline_check"] = ORACLES["regression_check"]
add("merge_datasets", f"""select name, cast(dense_rank() over (order by name) - 1 as bigint) new_id, n, case when not in_a then 'only_b' when not in_b then 'only_a' else 'common' end side, not (in_a and in_b) needs_decision
    from (select {TO} as name, count(*) n, bool_or(role = 'golden') in_a, bool_or(role = 'anchor') in_b from items where (role = 'golden' and label <> 'c9') or (role = 'anchor' and label <> 'c2') group by 1)""", ITEMS)

NMS = lambda source, key, thr: f"""nd as (select *, row_number() over (partition by {key} order by conf desc, pred_id) r from ({source})),
    ns as (select {key}, cast(0 as bigint) r, cast([] as struct(pred_id bigint, cx double, cy double, w double, h double)[]) kept from nd where r = 1
        union all select s.{key}, d.r, case when len(list_filter(s.kept, lambda k: {iou('k', 'd')} >= {thr})) > 0 then s.kept else list_append(s.kept, struct_pack(pred_id := d.pred_id, cx := d.cx, cy := d.cy, w := d.w, h := d.h)) end
        from ns s join nd d on d.{key} = s.{key} and d.r = s.r + 1),
    nms as (select {key}, unnest(arg_max(kept, r)).pred_id pred_id from ns group by {key})"""  # noqa: E731
add("loose_nms", "select image_id, pred_id from nms", EVAL, NMS("select image_id, pred_id, conf, cx, cy, cast(0.45 as double) w, cast(0.45 as double) h from eval_pred", "image_id", 0.3))
PROPOSED = f"""band as (select cast(cast(floor(i.id / 8) as bigint) as varchar) hash, i.id pred_id, i.confidence conf, i.embedding, b.cx, b.cy, cast(0.6 as double) w, cast(0.6 as double) h
    from items i join boxes b on b.id = i.id where i.role = 'candidate' and i.confidence >= 0.45 and i.confidence < 0.9), {NMS('select * from band', 'hash', 0.4)},
    pq as (select p.*, row_number() over (partition by id, nlabel order by round(sim, 9) desc, nid) k from (select b.hash, b.pred_id id, b.conf, r.id nid, r.label nlabel, list_cosine_similarity(b.embedding, r.embedding) sim
        from band b join nms n on n.pred_id = b.pred_id, items r where r.role = 'golden' and r.label in ('c0', 'c1', 'c2')) p),
    pv as (select hash, id, conf, max(case when r = 1 then bank end) top, round(max(case when r = 1 then s end) - max(case when r = 2 then s end), 4) margin, min(raw) raw from (select *, row_number() over (partition by id order by s desc, bank) r from (
        select q.hash, q.id, q.conf, q.nlabel bank, round(exp(-avg(1 - sim) / any_value(b.scale)), 4) s, round(avg(1 - sim), 4) raw from pq q join bs b on b.bank = q.nlabel where k <= 10 group by q.hash, q.id, q.conf, q.nlabel)) group by hash, id, conf),
    pa as (select hash, id pos, round(conf, 3) confidence, case when raw <= 0.9 and margin >= 0.004 then case top when 'c0' then 'defect_like' when 'c1' then 'reflection_like' else 'normal_like' end else 'unknown' end verdict,
        case when raw <= 0.9 and margin >= 0.004 then top end winning_bank, round(margin, 6) margin, round(raw, 6) min_raw_dist from pv)"""
add("proposal_audit", "select * from pa", ITEMS, SQL["boxes"], BANK, PROPOSED)
add("proposal_tags", "select distinct hash, 'proposal' tag from band union all select distinct hash, 'hard_positive' from pa where verdict in ('defect_like', 'unknown')", ITEMS, SQL["boxes"], BANK, PROPOSED)

# class pairs without their bootstrap
add("pair_separability", """select a, b, cast(ni as integer) ni, cast(nj as integer) nj, k, round(p, 4) sep_err, round(greatest(0, (p + z / (2 * n) - hw) / (1 + z / n)), 4) sep_lo, round(least(1, (p + z / (2 * n) + hw) / (1 + z / n)), 4) sep_hi, round(o_ij, 4) o_ij, round(o_ji, 4) o_ji
    from (select *, 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n)) hw from (select a, b, any_value(k) k, any_value(ni) ni, any_value(nj) nj, any_value(ni) + any_value(nj) n, count(*) filter (where (share > 0.5) <> (label = b)) / count(*) p,
        avg(case when label = a then share end) o_ij, avg(case when label = b then 1 - share end) o_ji, cast(1.96 * 1.96 as double) z from shares group by a, b))""", ITEMS,
    "cn as (select label, count(*) n from items group by label)",
    "cp as (select *, cast(least(case when r % 2 = 0 then r + 1 else r end, ni + nj - 1) as integer) k from (select x.label a, y.label b, x.n ni, y.n nj, greatest(3, cast(floor(sqrt(least(x.n, y.n))) as integer)) r from cn x join cn y on x.label < y.label))",
    """near_c as (select *, row_number() over (partition by id, nlabel order by sim desc, nid) rn from (select a.id, a.label, b.id nid, b.label nlabel, round(list_cosine_similarity(a.embedding, b.embedding), 9) sim from items a join items b on a.id <> b.id))""",
    """shares as (select a, b, id, label, any_value(k) k, any_value(ni) ni, any_value(nj) nj, avg((nlabel = b)::int) share from (select p.*, n.id, n.label, n.nlabel, row_number() over (partition by p.a, p.b, n.id order by n.sim desc, n.nlabel, n.nid) place
        from near_c n join cp p on n.label in (p.a, p.b) and n.nlabel in (p.a, p.b) where n.rn <= p.k) where place <= k group by a, b, id, label)""")
add("projection_transform", "select id, " + ", ".join(f"round(list_sum(list_transform(embedding, lambda v, r: (v - (r - 1) / cast(100 as double)) * ((((r - 1) * 7 + {c * 3}) % 5) - 2) / cast(10 as double))), 6) x{c}" for c in range(3)) + " from items", ITEMS)

# searches that depend on their own last step
add("fit_temperature", """select round((lo + hi) / 2, 4) temperature from ts where i = 60""", CAL,
    f"tc as (select c, count(*) n, sum(y) y from (select {CLIP} c, correct y from calib) group by c)",
    """ts as (select 0 i, cast(0.05 as double) lo, cast(10 as double) hi union all select i + 1, case when la < lb then lo else a end, case when la < lb then b else hi end from (
        select s.i, s.lo, s.hi, s.a, s.b, -sum(y * ln(pa) + (n - y) * ln(1 - pa)) la, -sum(y * ln(pb) + (n - y) * ln(1 - pb)) lb from (
            select s.*, n, y, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-ln(c / (1 - c)) / a)))) pa, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-ln(c / (1 - c)) / b)))) pb
            from (select i, lo, hi, lo + (hi - lo) / 3 a, hi - (hi - lo) / 3 b from ts where i < 60) s, tc) s group by s.i, s.lo, s.hi, s.a, s.b))""")
add("active_learning", """select cast(picked as integer) rank, id, round(unc, 6) uncertainty, round(nov, 6) novelty, round(score, 6) score from al where step = 25 and picked is not null""", ITEMS, near(CAND, GOLD, "true", "aln"),
    "alr as (select i.id, i.embedding, 1 - i.confidence unc, 1 - n.sim raw from items i join aln n on n.id = i.id and n.rn = 1)",
    "als as (select id, embedding, unc, (raw - (select min(raw) from alr)) / ((select max(raw) - min(raw) from alr) + 1e-12) nov from alr)",
    """al as (select 0 step, id, embedding, unc, nov, 0.5 * unc + 0.5 * nov score, cast(null as integer) picked from als union all
        select step + 1, id, embedding, unc, nov, case when picked is null and pos > 1 then score - 0.25 * greatest(0, list_cosine_similarity(embedding, chosen)) else score end, case when pos = 1 then step + 1 else picked end from (
            select *, case when picked is null then row_number() over (order by (picked is not null)::int, score desc, id) end pos, first_value(embedding) over (order by (picked is not null)::int, score desc, id) chosen from al where step < 25))""")
add("capacity", """select batch_id, volume, flag_rate, cast(floor(round(volume * flag_rate, 9)) as bigint) expected_reviews, 10 capacity, greatest(0, cast(floor(round(volume * flag_rate, 9)) as bigint) - 10) shortfall
    from (select batch_id, count(*) volume, round(avg((decision = 'review')::int), 4) flag_rate from ledger where event = 'route' group by batch_id)""", LED)
add("ap_series", """select label, seq, ap, round(ap - last_value(ap ignore nulls) over (partition by label order by seq rows between unbounded preceding and 1 preceding), 4) step from pts""", PTS)

# review write-back
DECIDED = "decided as (select image_hash hash, replace(arg_max(decision, seq), 'hardneg', 'scratch') decision from ledger where event = 'review' group by 1)"
add("resolve_reviews", "select hash, case when decision = 'false_alarm' then 'rejected' else 'golden' end tag, 'add' op from decided", LED, DECIDED)
add("unknown_ids", "select hash from decided where hash not in (select concat('u', cast(id as varchar)) from items where id % 3 <> 0)", views("items", "ledger"), DECIDED)
add("dismiss_ids", "select hash, tag, 'remove' op from decided, (values ('review'), ('proposal')) t(tag) where decision = 'false_alarm' union all select hash, 'review', 'add' from decided where decision = 'false_alarm' and hash like '%7'", LED, DECIDED)
add("queue_emission", "select 'overturned' queue, 'wrong' predict, 7 seq, hash id from decided where decision = 'confirmed'", LED, DECIDED)
add("admit_batch", """select cast(id as varchar) hash, 'admitted' tag, 'add' op, batch from items where batch in ('w1', 'w2', 'w5') and (batch = 'w5' or batch not in (select batch from bv where verdict = 'BLOCK'))""",
    ITEMS, "bv as (" + ORACLES["batch_gate"].replace("with recursive", "with", 1) + ")")
add("flagged_planned", "select id from items where split = 'train' and confidence < 0.5", ITEMS)
add("class_gather", """select label, count(*) n, round(sum(list_sum(embedding)), 6) total from (select *, cast(floor(id / 4) as bigint) g from items) i
    where g in (select cast(floor(id / 4) as bigint) from items where batch = 'w2') and g not in (select cast(floor(id / 4) as bigint) from items where role = 'anchor') and id % 9 <> 0 group by label""", ITEMS)
add("windowed_review_rates", "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, batch_id, count(*) n, round(avg((decision = 'review')::int), 6) review_rate from ledger where event = 'route' group by all", LED)
CHAIN = """ch as (select seq, concat('{"decision":"', case when seq % 997 = 7 then 'pass' else decision end, '","event":"', event, '","seq":', cast(seq as varchar), '}') raw, sha256(concat('{"decision":"', decision, '","event":"', event, '","seq":', cast(seq as varchar), '}')) entry_hash from ledger),
    cl as (select *, case when seq % 501 = 500 then 'cut' else coalesce(lag(entry_hash) over (order by seq), '') end prev_hash from ch),
    cv as (select seq, prev_hash = coalesce(lag(entry_hash) over (order by seq), '') link_ok, sha256(raw) = entry_hash hash_ok from cl)"""
add("verify_chain", "select * from cv", LED, CHAIN)
add("report_class_diff", "select label, 'new' change from (select label from items where batch = 'w2' and id < 60 except select label from items where batch = 'w0' and id < 60) union all select label, 'removed' from (select label from items where batch = 'w0' and id < 60 except select label from items where batch = 'w2' and id < 60)", ITEMS)
add("pre_train_gate", """select case when len(r) = 0 then 'GO' else 'NO-GO' end verdict, array_to_string(r, ',') reasons, u under_represented from (select list_filter([case when (select count(*) from items where role = 'golden') = 0 then 'no_golden' end,
    case when (select count(*) from items where role = 'golden' and split = 'test') > 0 then 'eval_golden_overlap' end, case when (select count(distinct fab) from items) > 1 then 'backend_mixed' end, case when (select count(*) from items where confidence < 0.42) > 0 then 'review_open' end,
    case when (select count(*) from (select group_id from comp join items using (id) group by group_id having bool_or(role = 'golden') and bool_or(role <> 'golden'))) > 0 then 'golden_train_overlap' end, case when u <> '' then 'under_represented' end,
    case when (select max({COS}) from a join b on a.k = b.k) > 0.15 or (select c from base) - (select c from q) > 0.05 then 'drift' end, case when not (select bool_and(link_ok and hash_ok) from cv) then 'chain_broken' end], lambda x: x is not null) r, u
    from (select coalesce(string_agg(label, ',' order by label), '') u from (select label from items where role = 'golden' group by label having count(*) < 25)))""".replace("{COS}", COS),
    views("items", "ledger"), DUP, CHAIN, centroid("role = 'anchor'", "a"), centroid(CAND, "b"), consistency("role = 'anchor'", GOLD, "base"), consistency(CAND, "role = 'anchor'", "q"))
