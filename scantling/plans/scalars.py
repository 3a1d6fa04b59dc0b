"""Queries for scalar functions, over detections."""

from __future__ import annotations

from pyspark.sql import functions

from scantling.functions import costs as cost_models
from scantling.functions import geometry
from scantling.functions import predicates as conditions
from scantling.plans.base import Registry
from scantling.plans.later import Later, later, now
from scantling.sources import views

QUERIES = Registry()
# queries are named without a session, so their columns are written down here and made when they run
F, g, predicates, costs = later(functions), later(geometry), later(conditions), later(cost_models)
CODEC, NETWORKS = cost_models.CODEC, cost_models.NETWORKS
KEYS = ["frame", "line", "xmin", "ymin"]
BOX = g.rect("xmin", "ymin", "xmax", "ymax")
VALID = (400.0, 300.0, 1200.0, 800.0)
BANS = [(0.0, 0.0, 300.0, 300.0), (1000.0, 500.0, 1500.0, 900.0)]
V = g.fixed(*VALID)
W, H, A = "(xmax-xmin)", "(ymax-ymin)", "((xmax-xmin)*(ymax-ymin))"


def inter(r: tuple, box=("xmin", "ymin", "xmax", "ymax")) -> str:
    w, h = f"(least({box[2]},{r[2]})-greatest({box[0]},{r[0]}))", f"(least({box[3]},{r[3]})-greatest({box[1]},{r[1]}))"
    return f"(CASE WHEN {w}>0 AND {h}>0 THEN {w}*{h} ELSE 0 END)"


def trunc(e: str) -> str:
    return f"CAST(trunc({e}) AS INT)"


def scalar(name: str, out: dict[str, tuple[Later, str]], view: str = "det", keys: list[str] = KEYS, where: tuple[Later, str] | None = None) -> None:
    """A query that keeps ``keys`` of a view and adds columns, each as a Column and as SQL."""
    sql = f"{views.with_views(view)} SELECT {', '.join(keys)}, {', '.join(f'{s} AS {c}' for c, (_, s) in out.items())} FROM v_{view}" + (f" WHERE {where[1]}" if where else "")

    def run(spark, sf_dir):
        df = views.read(spark, sf_dir, view)
        return (df.where(now(where[0])) if where else df).select(*keys, *[now(c).alias(n) for n, (c, _) in out.items()])

    QUERIES.add(name, sql)(run)


r6 = lambda c: F.round(c, 6)
s6 = lambda e: f"round({e}, 6)"
FLIP = g.rect("xmax", "ymax", "xmin", "ymin", scale=0.5)
CORNERS = ("x1", "y1", "x2", "y2")
BOX_SQL = ("xmin", "ymin", "xmax", "ymax")

scalar("g01_rect_normalise", {n: (FLIP[n], f"{s}*CAST(0.5 AS DOUBLE)") for n, s in zip(CORNERS, BOX_SQL, strict=True)})
scalar("g02_rect_accessors", {
    "w": (g.width(BOX), W), "h": (g.height(BOX), H), "ix2": (g.truncated(BOX)["x2"], trunc("xmax")), "rt_x": (BOX["x2"], "xmax"), "lb_y": (BOX["y2"], "ymax")})
scalar("g03_centre", {"cx": (g.centre_x(BOX), "(xmin+xmax)/2"), "cy": (g.centre_y(BOX), "(ymin+ymax)/2")})
scalar("g04_diagonal", {"d": (r6(g.diagonal(BOX)), s6(f"sqrt({W}*{W}+{H}*{H})"))})
scalar("g05_area", {"area": (r6(g.area(BOX)), s6(A))})
scalar("g06_contains_point", {"inside": (g.contains(V, "xmin", "ymin"), f"xmin BETWEEN {VALID[0]} AND {VALID[2]} AND ymin BETWEEN {VALID[1]} AND {VALID[3]}")})
scalar("g07_includes", {"included": (g.includes(V, BOX), f"xmin>={VALID[0]} AND xmax<={VALID[2]} AND ymin>={VALID[1]} AND ymax<={VALID[3]}")})
scalar("g08_touches", {"touching": (g.touches(BOX, V), f"xmin<={VALID[2]} AND xmax>={VALID[0]} AND ymin<={VALID[3]} AND ymax>={VALID[1]}")})
OV = g.overlap(BOX, V)
scalar("g09_overlap", {n: (OV[n], f"CASE WHEN {inter(VALID)}>0 THEN {f}({s},{v}) END") for n, s, v, f in zip(CORNERS, BOX_SQL, VALID, ("greatest", "greatest", "least", "least"), strict=True)})
VA = (VALID[2] - VALID[0]) * (VALID[3] - VALID[1])
scalar("g10_iou", {"iou": (r6(g.iou(BOX, V)), s6(f"{inter(VALID)}/({A}+{VA}-{inter(VALID)})"))})
scalar("g11_centre_distance", {"d": (r6(g.centre_distance(BOX, V)), s6("sqrt(pow((xmin+xmax)/2-800,2)+pow((ymin+ymax)/2-550,2))"))})
ED = g.edge_distance(BOX, V)
DV = f"least(abs(ymin-{VALID[1]}),abs(ymin-{VALID[3]}),abs(ymax-{VALID[1]}),abs(ymax-{VALID[3]}))"
DH = f"least(abs(xmin-{VALID[0]}),abs(xmin-{VALID[2]}),abs(xmax-{VALID[0]}),abs(xmax-{VALID[2]}))"
scalar("g12_edge_distance", {"d": (r6(ED["d"]), s6(f"least({DV},{DH})")), "direction": (ED["direction"], f"CASE WHEN {DV}<{DH} THEN 1 WHEN {DH}<{DV} THEN 2 ELSE 3 END")})
M = g.merge(BOX, V)
scalar("g13_merge", {n: (M[n], f"{f}({s},{v})") for n, s, v, f in zip(CORNERS, BOX_SQL, VALID, ("least", "least", "greatest", "greatest"), strict=True)})
OUTER = g.fixed(0, 0, 2000, 2000)
SUR = g.surrounding(OUTER, BOX)
scalar("g14_surrounding", {
    "n": (F.size(SUR), "(CASE WHEN xmin>0 THEN 1 ELSE 0 END+CASE WHEN xmax<2000 THEN 1 ELSE 0 END+1)*(CASE WHEN ymin>0 THEN 1 ELSE 0 END+CASE WHEN ymax<2000 THEN 1 ELSE 0 END+1)-1"),
    "area": (r6(F.aggregate(SUR, F.lit(0.0), lambda a, r: g.area(r) + a)), s6(f"4000000-{A}"))}, where=(F.expr("xmax<2000 AND ymax<2000"), "xmax<2000 AND ymax<2000"))
scalar("g15_truncated_point", {"ix": ((F.col("xmax") * 0.37).cast("int"), trunc("xmax*CAST(0.37 AS DOUBLE)")), "iy": ((F.col("ymax") * -0.37).cast("int"), trunc("ymax*CAST(-0.37 AS DOUBLE)"))})
scalar("g16_iou_disjoint_zero", {"iou": (r6(F.when(g.overlap(BOX, V).isNull(), 0.0).otherwise(g.iou(BOX, V))), s6(f"CASE WHEN {inter(VALID)}=0 THEN 0 ELSE {inter(VALID)}/({A}+{VA}-{inter(VALID)}) END"))})
scalar("g17_overlap_share", {"share": (r6(g.overlap_share(BOX, V)), s6(f"{inter(VALID)}/{A}"))})
C4 = g.to_centre(BOX)
BACK = g.from_centre(C4["cx"], C4["cy"], C4["w"], C4["h"])
scalar("g19_centre_format", {"cx": (C4["cx"], "(xmin+xmax)/2"), "cw": (C4["w"], W), "back_x1": (r6(BACK["x1"]), s6("xmin")), "back_y2": (r6(BACK["y2"]), s6("ymax"))})
scalar("g20_absolute_box", {"ax1": (g.shift(BOX, F.col("line") * 10, 5.0)["x1"], "xmin+line*10"), "ay2": (g.shift(BOX, F.col("line") * 10, 5.0)["y2"], "ymax+5")})
AF = g.affine(BOX, 1.5, 0.75, 8.0, -4.0)
scalar("g21_affine", {"ax2": (r6(AF["x2"]), s6("xmax*CAST(1.5 AS DOUBLE)+8")), "ay1": (r6(AF["y1"]), s6("ymin*CAST(0.75 AS DOUBLE)-4"))})
scalar("g22_network_side", {"side": (g.network_side("xmax", 0.5), "CAST(greatest(floor(xmax*CAST(0.5 AS DOUBLE)/64)*64,64) AS INT)")})
scalar("g23_even_floor", {"v": (g.even_floor("xmax"), "CAST(floor(xmax/2)*2 AS INT)")})


def around(w: str, h: str) -> dict[str, str]:
    x, y = f"trunc((xmin+xmax)/2-({w})/2)", f"trunc((ymin+ymax)/2-({h})/2)"
    return {"x1": f"CAST({x} AS DOUBLE)", "y1": f"CAST({y} AS DOUBLE)", "x2": f"CAST({x}+trunc({w}) AS DOUBLE)", "y2": f"CAST({y}+trunc({h}) AS DOUBLE)"}


LIN, EXP, LEAST = g.inflate_linear(BOX, 1.25), g.inflate_exponential(BOX, 1.01, 0.5), g.inflate_least(BOX, 60)
scalar("g24_inflate_linear", {n: (LIN[n], s) for n, s in around(f"{W}*CAST(1.25 AS DOUBLE)", f"{H}*CAST(1.25 AS DOUBLE)").items()})
scalar("g24_inflate_exponential", {n: (EXP[n], s) for n, s in around(*[f"((CAST(0.5 AS DOUBLE)*pow(CAST(1.01 AS DOUBLE),-{x})+1)*{x})" for x in (W, H)]).items()})
NX, NY = f"(CASE WHEN {W}<60 THEN trunc((xmin+xmax)/2-30) ELSE xmin END)", f"(CASE WHEN {H}<60 THEN trunc((ymin+ymax)/2-30) ELSE ymin END)"
scalar("g24_inflate_least", {"x1": (LEAST["x1"], NX), "y1": (LEAST["y1"], NY), "x2": (LEAST["x2"], f"{NX}+greatest({W},60)"), "y2": (LEAST["y2"], f"{NY}+greatest({H},60)")})


def line(name: str, a: str) -> str:
    return f"({a}*CAST({CODEC['k_' + name]!r} AS DOUBLE)+CAST({CODEC['b_' + name]!r} AS DOUBLE))"


scalar("g25_codec_cost", {"ms": (r6(costs.random_access(g.area(BOX))), s6(f"{line('init', A)}+{line('skip', A)}*14+{line('dec', A)}+{line('rel', A)}"))})
NET = {n: (r6(costs.network(g.area(BOX) * 50, c)), s6(f"CASE WHEN {A}*50>({c['a']}-{c['b']})/{c['k']!r} THEN {A}*50*CAST({c['k']!r} AS DOUBLE)+{c['b']} ELSE {c['a']} END")) for n, c in NETWORKS.items()}
scalar("g26_network_cost", NET)
PRED = costs.predicted(g.area(BOX), F.col("line"))
scalar("g27_predicted_cost", {"t_init": (r6(PRED["t_init"]), s6(line("init", A))), "t_total": (r6(PRED["t_total"]), s6(f"{line('init', A)}+{line('skip', A)}*line+{line('dec', A)}+{line('rel', A)}"))})
scalar("g28_relative_error", {"err": (r6(costs.relative_error(F.col("ms") * 1.1, F.col("ms"))), s6("(ms*CAST(1.1 AS DOUBLE)-ms)/ms*100"))}, "calib", ["h", "w", "ms"])
scalar("g29_bitrate", {
    "num": (g.bitrate_number(F.concat(F.col("h").cast("string"), F.element_at(F.array(F.lit("k"), F.lit("m"), F.lit("g")), (F.col("w") % 3 + 1).cast("int")))), "h*CAST(CASE w%3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1e9 END AS DOUBLE)"),
    "txt": (g.bitrate_text(F.col("h") * F.col("w")), "CASE WHEN h*w>1000 THEN CAST(round_even(h*w/1000, 0) AS BIGINT)||'k' END")}, "calib", ["h", "w", "ms"])
TXT = g.to_text(BOX)
PARSED = g.from_text(TXT)
scalar("g30_rect_text", {"txt": (TXT, f"'('||CAST(xmin AS BIGINT)||', '||CAST(ymin AS BIGINT)||', '||CAST({W} AS BIGINT)||', '||CAST({H} AS BIGINT)||')'"), "x2": (PARSED["x2"], "xmax"), "y2": (PARSED["y2"], "ymax")})
E3 = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
scalar("g31_l2", {"d": (r6(g.l2(F.col("embedding"), F.reverse("embedding"))), s6("sqrt(list_sum(list_transform(range(1,65), lambda i: pow(CAST(embedding[i] AS DOUBLE)-CAST(embedding[65-i] AS DOUBLE),2))))"))}, "tile", ["tile_id"])
SUMS = "list_sum(list_transform(range(1,65), lambda i: {}))"
scalar("g32_cosine", {"c": (r6(g.cosine(F.col("embedding"), F.reverse("embedding"))), s6(f"{SUMS.format('CAST(embedding[i] AS DOUBLE)*CAST(embedding[65-i] AS DOUBLE)')}/{SUMS.format('CAST(embedding[i] AS DOUBLE)*CAST(embedding[i] AS DOUBLE)')}"))}, "tile", ["tile_id"])
SM = g.softmax(E3)
scalar("g33_softmax", {
    "p1": (r6(F.get(SM, F.lit(0))), s6("exp(CAST(embedding[1] AS DOUBLE))/list_sum(list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE))))")),
    "top": (r6(F.array_max(SM)), s6("exp(CAST(list_max(embedding[1:10]) AS DOUBLE))/list_sum(list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE))))")),
    "arg": ((F.array_position(F.slice("embedding", 1, 10), F.array_max(F.slice("embedding", 1, 10))) - 1).cast("int"), "CAST(list_position(embedding[1:10], list_max(embedding[1:10]))-1 AS INT)")}, "tile", ["tile_id"])
scalar("g34_sigmoid", {"p": (r6(g.sigmoid((F.col("proxy_score") - 0.5) * 10)), s6("1/(1+exp(-(proxy_score-CAST(0.5 AS DOUBLE))*10))")), "yes": (g.sigmoid((F.col("proxy_score") - 0.5) * 10) > 0.5, "proxy_score>CAST(0.5 AS DOUBLE)")}, "proxy", ["id"])
scalar("g35_normalise", {"v": (r6(F.get(g.normalise(F.col("embedding"), 0.485, 0.229), F.lit(0))), s6("(CAST(embedding[1] AS DOUBLE)/255-CAST(0.485 AS DOUBLE))/CAST(0.229 AS DOUBLE)"))}, "tile", ["tile_id"])
scalar("g36_rescale_frame", {"dst": (g.rescale_frame("t", 10, 30), "t*3")}, "workload", ["workload_id", "ord", "t"])
XS, YS = F.array("xmin", "xmax", "xmax", "xmin"), F.array("ymin", "ymin", "ymax", F.col("ymax") + 10)
scalar("g37_polygon_area", {"area": (r6(g.polygon_area(XS, YS)), s6(f"{W}*{H}+{W}*10/2"))})

ROI = g.rect("x1", "y1", "x2", "y2")
RS = ("x1", "y1", "x2", "y2")
RA = "((x2-x1)*(y2-y1))"
RK = ["roi_id", "t"]
BAN = [g.fixed(*b) for b in BANS]
over = lambda r: inter(r, RS)
scalar("p01_area_filter", {"area": (r6(g.area(ROI)), s6(RA))}, "roi", RK, (predicates.clear_of(ROI, BAN), " AND ".join(f"NOT {over(b)}>CAST(0.3 AS DOUBLE)*{RA}" for b in BANS)))
scalar("p02_size_filter", {"w": (g.width(ROI), "x2-x1")}, "roi", RK, (predicates.size_between(ROI, 40, 30, 150, 120), "x2-x1>=40 AND y2-y1>=30 AND x2-x1<=150 AND y2-y1<=120"))
scalar("p03_valid_area", {"w": (g.width(ROI), "x2-x1")}, "roi", RK, (predicates.mostly_in(ROI, V), f"{over(VALID)}>CAST(0.5 AS DOUBLE)*{RA}"))
SCORE = f"object_name IN ('A','R') AND {inter(VALID)}>=CAST(0.7 AS DOUBLE)*{A} AND {inter(VALID)}>0 AND " + " AND ".join(f"NOT ({inter(b)}>=CAST(0.3 AS DOUBLE)*{A} AND {inter(b)}>0)" for b in BANS)
scalar("p04_object_score", {"hit": (predicates.object_counts(F.col("object_name"), BOX, V, BAN, ["A", "R"]), SCORE)})
scalar("p05_confident_class", {"confidence": (F.col("confidence"), "confidence")}, where=(predicates.confident(F.col("confidence"), F.col("object_name"), ["A", "N"]), "confidence>CAST(0.5 AS DOUBLE) AND object_name IN ('A','N')"))
scalar("p08_min_confidence", {"confidence": (F.col("confidence"), "confidence")}, where=(F.col("confidence") >= conditions.MIN_CONFIDENCE["mask"], "confidence>=CAST(0.8 AS DOUBLE)"))
scalar("p13_positive_proxy", {"proxy_score": (F.col("proxy_score"), "proxy_score")}, "proxy", ["id"], (F.col("proxy_score") - 0.3 > 0, "proxy_score-CAST(0.3 AS DOUBLE)>0"))
scalar("p14_binary_label", {"y": (predicates.binary(F.col("truth")), "CASE WHEN truth>0 THEN CAST(1 AS DOUBLE) ELSE 0 END")}, "tile", ["tile_id"])
scalar("p06_region_rect", {"share": (r6(g.overlap_share(BOX, V)), s6(f"{inter(VALID)}/{A}"))}, where=(
    predicates.in_region(BOX, V, BAN), f"{inter(VALID)}>0 AND {inter(VALID)}/{A}>=CAST(0.25 AS DOUBLE) AND " + " AND ".join(f"NOT {inter(b)}/{A}>CAST(0.6 AS DOUBLE)" for b in BANS)))
scalar("p07_region_strict", {"share": (r6(g.overlap_share(BOX, V)), s6(f"{inter(VALID)}/{A}"))}, where=(
    predicates.in_region_strict(BOX, F.col("confidence"), V, BAN, 0.2), f"confidence>=CAST(0.2 AS DOUBLE) AND {inter(VALID)}/{A}>CAST(0.25 AS DOUBLE) AND NOT ({'+'.join(inter(b) for b in BANS)})/{A}>CAST(0.6 AS DOUBLE)"))
