"""DuckDB SQL that the registered queries are checked against, over the same tables; written from the semantics, not from the plans."""

from __future__ import annotations

GRID = """
xs AS (SELECT unnest(list_distinct(list_append(range(0, 3072, 896), 3072))) AS tx),
ys AS (SELECT unnest(list_distinct(list_append(range(0, 1872, 896), 1872))) AS ty),
grid AS (SELECT row_number() OVER (ORDER BY ty, tx) - 1 AS idx, printf('Tile_%03d', row_number() OVER (ORDER BY ty, tx)) AS tile_id, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty
  FROM xs, ys)"""
PAIRS = """
pairs AS MATERIALIZED (
  SELECT a.idx * 10000 + b.idx AS pair_ord, a.tile_id AS a, b.tile_id AS b, CASE WHEN a.ty = b.ty THEN 'vertical' ELSE 'horizontal' END AS orientation,
         greatest(a.tx, b.tx) AS o0, greatest(a.ty, b.ty) AS o1, least(a.tx, b.tx) + 1024 - greatest(a.tx, b.tx) AS o2, least(a.ty, b.ty) + 1024 - greatest(a.ty, b.ty) AS o3
  FROM grid a JOIN grid b ON a.idx < b.idx AND (a.tx = b.tx OR a.ty = b.ty) AND abs(a.tx - b.tx) < 1024 AND abs(a.ty - b.ty) < 1024)"""
SIDES = "sides AS MATERIALIZED (SELECT *, a AS t, 'a' AS side FROM pairs UNION ALL SELECT *, b, 'b' FROM pairs)"

#: Tiles of each page, and pairs of them.
LAYOUT = """
tiles AS MATERIALIZED (SELECT page, idx, printf('T%02d', idx) AS tile_id, CAST((idx % across) * (size - over) AS DOUBLE) AS tx,
    CAST((idx // across) * (size - over) + CASE WHEN idx % 11 = 7 THEN 1 ELSE 0 END AS DOUBLE) AS ty,
    CAST(size + CASE WHEN event_id % 5 = 0 THEN 180 ELSE 0 END AS DOUBLE) AS tw, CAST(size + CASE WHEN event_id % 7 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS th
  FROM (SELECT event_id, event_id // 25 AS page, event_id % 25 AS idx, 3 + (event_id // 25) % 4 AS across, 600 + 50 * ((event_id // 25) % 5) AS size, 64 * ((event_id // 25) % 3) AS over FROM events))"""
LAYOUT_PAIRS = """
pairs AS MATERIALIZED (
  SELECT page, pair_ord, a, b, orientation, o0, o1, CASE WHEN hit THEN w WHEN vertical THEN 0 ELSE least(aw, bw) END AS o2, CASE WHEN hit THEN h WHEN vertical THEN least(ah, bh) ELSE 0 END AS o3 FROM (
    SELECT a.page, (a.idx << 32) | b.idx AS pair_ord, a.tile_id AS a, b.tile_id AS b, a.ty = b.ty AS vertical, CASE WHEN a.ty = b.ty THEN 'vertical' ELSE 'horizontal' END AS orientation,
      greatest(a.tx, b.tx) AS o0, greatest(a.ty, b.ty) AS o1, least(a.tx+a.tw, b.tx+b.tw) - greatest(a.tx, b.tx) AS w, least(a.ty+a.th, b.ty+b.th) - greatest(a.ty, b.ty) AS h,
      w > 0 AND h > 0 AS hit, a.tw AS aw, b.tw AS bw, a.th AS ah, b.th AS bh
    FROM tiles a JOIN tiles b ON a.page = b.page AND a.idx < b.idx AND (a.tx = b.tx OR a.ty = b.ty))
  WHERE hit OR w = 0 OR h = 0)"""
LAYOUT_SLICES = """
q AS (SELECT tru.*, tiles.idx, tile_id, tx, ty, greatest(x, tx) AS vx, greatest(y, ty) AS vy, least(x+w, tx+tw) - greatest(x, tx) AS vw, least(y+h, ty+th) - greatest(y, ty) AS vh
  FROM tru JOIN tiles ON tru.page = tiles.page),
s0 AS (SELECT page, id, idx, tile_id, tx, ty, vx-tx AS g0, vy-ty AS g1, vw AS g2, vh AS g3, label, confidence FROM q WHERE vw > 0 AND vh > 0 AND vw*vh >= 0.3::DOUBLE*(w*h)),
sl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page, tile_id ORDER BY id) - 1 AS item_idx FROM s0)"""


#: Strokes of each supplier's tile by pixel, what each pixel votes for, and the places that none near them surpasses.
LINE_PEAKS = """
k AS (SELECT s_suppkey AS tile, k, 90 + (s_suppkey*13 + k*29) % 80 AS n, s_suppkey*7 + k*41 AS turn, (s_suppkey*5 + k*3) % 4 AS way FROM supplier, (SELECT unnest(range(0, 3)) AS k)),
m AS (SELECT tile, k, way, 128 - n // 2 + i AS major, 128 + 9*k + CAST(floor(((2*i - n) * (turn % (2*n + 1) - n) + n) / (2.0::DOUBLE * n)) AS BIGINT) AS minor
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM k) WHERE k <> 1 OR i % 10 < 8),
px AS MATERIALIZED (SELECT DISTINCT tile, CASE WHEN way < 2 THEN major ELSE minor END AS x, CASE WHEN way < 2 THEN minor ELSE major END AS y FROM m),
turns AS (SELECT a, round(cos(radians(a)) * 65536)::BIGINT AS c, round(sin(radians(a)) * 65536)::BIGINT AS s FROM (SELECT unnest(range(0, 180)) AS a)),
v AS (SELECT tile, a, c, s, CAST(floor((x*c + y*s + 32768) / 65536.0::DOUBLE) AS BIGINT) AS rho, count(*) AS votes FROM px, turns GROUP BY ALL HAVING count(*) >= 60),
pk AS MATERIALIZED (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM (SELECT tile, a, rho, votes, a AS seen, rho AS at FROM v UNION ALL SELECT tile, a, rho, votes, a - 180, -rho FROM v
    UNION ALL SELECT tile, a, rho, votes, a + 180, -rho FROM v) w WHERE w.tile = v.tile AND abs(w.seen - v.a) <= 2 AND abs(w.at - v.rho) <= 2 AND (w.votes, -w.a, -w.rho) > (v.votes, -v.a, -v.rho)))"""
LINES = f"""WITH {LINE_PEAKS},
near AS MATERIALIZED (SELECT *, CAST(floor((x*c + y*s + 32768) / 65536.0::DOUBLE) AS BIGINT) - rho AS off, CAST(floor((y*c - x*s + 32768) / 65536.0::DOUBLE) AS BIGINT) AS t
  FROM px JOIN pk USING (tile) WHERE abs(floor((x*c + y*s + 32768) / 65536.0::DOUBLE) - rho) <= 2),
own AS (SELECT *, row_number() OVER (PARTITION BY tile, x, y ORDER BY votes DESC, a, rho) = 1 AS mine FROM near),
pl AS (SELECT tile, a, c, s, rho, votes, t, max(mine::INT) AS mine FROM own WHERE abs(off) <= 1 GROUP BY ALL),
st AS (SELECT *, coalesce(t - lag(t) OVER w > 5, true)::INT AS fresh FROM pl WINDOW w AS (PARTITION BY tile, a, rho ORDER BY t)),
il AS (SELECT *, sum(fresh) OVER (PARTITION BY tile, a, rho ORDER BY t) AS piece FROM st),
seg AS (SELECT tile, a, c, s, rho, votes, min(t) AS t0, max(t) AS t1 FROM il GROUP BY tile, a, c, s, rho, votes, piece HAVING max(t) - min(t) >= 60 AND 2*sum(mine) >= count(*)),
e AS (SELECT *, CASE WHEN s > 0 THEN t1 ELSE t0 END AS p, CASE WHEN s > 0 THEN t0 ELSE t1 END AS q FROM seg)
SELECT tile, a AS angle, rho, votes, t0, t1, round((rho*c - p*s) / 65536.0::DOUBLE, 6) AS x1, round((rho*s + p*c) / 65536.0::DOUBLE, 6) AS y1,
  round((rho*c - q*s) / 65536.0::DOUBLE, 6) AS x2, round((rho*s + q*c) / 65536.0::DOUBLE, 6) AS y2, round(least(0.95::DOUBLE, 0.3::DOUBLE + (t1-t0)/1448.0::DOUBLE), 9) AS score
FROM e QUALIFY row_number() OVER (PARTITION BY tile ORDER BY t1-t0 DESC, a, rho, t0) <= 150"""

PAGE = "event_id // 25"
DENSE = "user_id % 40"
OWN = "own"  # pages of PAGE with tiles of their own


def truth(kind: str, page: str = PAGE) -> str:
    number = lambda **c: ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in c.items())
    if kind == "object":
        geometry = number(x="(event_id*7919)%3700", y="(event_id*6007+user_id*211)%2500", w="40+(event_id*31)%350", h="30+(event_id*17)%320")
        label = "event_type"
    elif kind == "ocr":
        geometry = number(x="(event_id*7907)%3800", y="(event_id*5987+user_id*97)%2700", w="60+(event_id*13)%200", h="16+(event_id*7)%30")
        label = "'M' || (event_id % 97) || ' ' || upper(event_type)"
    else:
        x, y = "(event_id*7901)%3000", "(event_id*5981+user_id*89)%2800"
        geometry = number(x1=x, y1=y, x2=f"{x}+200+(event_id*29)%880", y2=f"{y}+event_id%3")
        label = "CASE WHEN event_id % 4 = 0 THEN 'leader_line' ELSE 'dimension_line' END"
    return f"tru AS (SELECT {page} AS page, event_id AS id, {geometry}, {label} AS label, CAST((event_id*37)%100 AS DOUBLE)/100 AS confidence FROM events)"


def sliced(kind: str, page: str = PAGE) -> str:
    """sl: page, id, idx, tile_id, tx, ty, g0..g3 (tile pixels), label, confidence, item_idx"""
    if kind == "arrow":
        body = """
p AS (SELECT tru.*, grid.*, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least((tx - x1)/(x2-x1), (tx+1024-x1)/(x2-x1)), CASE WHEN y1 = y2 THEN 0
  ELSE least((ty-y1)/(y2-y1), (ty+1024-y1)/(y2-y1)) END) AS t0,
      least(1, greatest((tx - x1)/(x2-x1), (tx+1024-x1)/(x2-x1)), CASE WHEN y1 = y2 THEN 1 ELSE greatest((ty-y1)/(y2-y1), (ty+1024-y1)/(y2-y1)) END) AS t1
      FROM tru, grid WHERE y1 <> y2 OR (y1 >= ty AND y1 <= ty + 1024)),
q AS (SELECT *, x1+t0*dx AS cx1, y1+t0*dy AS cy1, x1+t1*dx AS cx2, y1+t1*dy AS cy2 FROM p WHERE t0 <= t1),
s0 AS (SELECT page, id, idx, tile_id, tx, ty, cx1-tx AS g0, cy1-ty AS g1, cx2-tx AS g2, cy2-ty AS g3, label, confidence FROM q
  WHERE sqrt((cx2-cx1)*(cx2-cx1)+(cy2-cy1)*(cy2-cy1)) >= 10)"""
    else:
        seen = 0.9 if kind == "ocr" else 0.3
        body = f"""
q AS (SELECT tru.*, grid.*, greatest(x, tx) AS vx, greatest(y, ty) AS vy, least(x+w, tx+1024) - greatest(x, tx) AS vw, least(y+h, ty+1024) - greatest(y, ty) AS vh
  FROM tru, grid),
s0 AS (SELECT page, id, idx, tile_id, tx, ty, vx-tx AS g0, vy-ty AS g1, vw AS g2, vh AS g3, label, confidence FROM q
  WHERE vw > 0 AND vh > 0 AND vw*vh >= {seen}::DOUBLE*(w*h))"""
    return f"{GRID}, {truth(kind, page)}, {body}, sl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page, tile_id ORDER BY id) - 1 AS item_idx FROM s0)"


RANK = {"object": 0, "ocr": 1, "arrow": 2}
LEAST = {"object": 0.25, "ocr": 0.30, "arrow": 0.30}


def near(kind: str, page: str = PAGE) -> str:
    """c: thresholded candidates on the canvas; n: those near a seam."""
    if kind == "arrow":
        geom, box = "g0+tx AS g0, g1+ty AS g1, g2+tx AS g2, g3+ty AS g3", "least(g0,g2) AS b0, least(g1,g3) AS b1, greatest(g0,g2)-least(g0,g2) AS b2, greatest(g1,g3)-least(g1,g3) AS b3"
    else:
        geom, box = "g0+tx AS g0, g1+ty AS g1, g2, g3", "g0 AS b0, g1 AS b1, g2 AS b2, g3 AS b3"
    start, same = (f"{LAYOUT}, {truth(kind)}, {LAYOUT_SLICES}, {LAYOUT_PAIRS}", " AND c.page = p.page") if page == OWN else (f"{sliced(kind, page)}, {PAIRS}", "")
    return f"""{start}, {SIDES},
c0 AS (SELECT page, tile_id, tile_id || ':{kind}:' || item_idx AS uid, ((idx*3+{RANK[kind]}) << 40) + item_idx AS ord, {geom}, label, confidence FROM sl
  WHERE confidence >= {LEAST[kind]}::DOUBLE),
c AS MATERIALIZED (SELECT *, {box} FROM c0),
n AS MATERIALIZED (SELECT c.*, p.pair_ord, p.orientation, p.o0, p.o1, p.o2, p.o3, p.side FROM c
  JOIN sides p ON c.tile_id = p.t{same}
      WHERE least(b0+b2+1, o0+o2+48) > greatest(b0-1, o0-48) AND least(b1+b3+1, o1+o3+48) > greatest(b1-1, o1-48))"""


def _iou(a: str, b: str) -> str:
    i = f"(greatest(0, least({a}0+{a}2, {b}0+{b}2)-greatest({a}0,{b}0)) * greatest(0, least({a}1+{a}3, {b}1+{b}3)-greatest({a}1,{b}1)))"
    return f"({i} / ({a}2*{a}3 + {b}2*{b}3 - {i} + 1e-9))"


def _cut(p: str, out: str) -> str:
    return f"greatest({p}.g0,o0-2) AS {out}0, greatest({p}.g1,o1-2) AS {out}1, least({p}.g0+{p}.g2,o0+o2+2)-greatest({p}.g0,o0-2) AS {out}2, least({p}.g1+{p}.g3,o1+o3+2)-greatest({p}.g1,o1-2) AS {out}3"


def edges(kind: str, page: str = PAGE) -> str:
    """e: page, pair_ord, src, dst"""
    pairs = f"""ab AS MATERIALIZED (SELECT a.page, a.pair_ord, a.orientation, a.uid AS src, b.uid AS dst, a.g0 AS p0, a.g1 AS p1, a.g2 AS p2, a.g3 AS p3, b.g0 AS q0, b.g1 AS q1, b.g2 AS q2, b.g3 AS q3{', ' + _cut('a', 'u') + ', ' + _cut('b', 'v') if kind != 'arrow' else ''}
      FROM (SELECT * FROM n WHERE side = 'a') a JOIN (SELECT page, pair_ord, uid, g0, g1, g2, g3 FROM n
      WHERE side = 'b') b ON a.page = b.page AND a.pair_ord = b.pair_ord)"""
    clipped = f"(u2 > 0 AND u3 > 0 AND v2 > 0 AND v3 > 0 AND {_iou('u', 'v')} >= 0.5)"
    if kind == "object":
        rule = f"{clipped} OR {_iou('p', 'q')} >= 0.5"
    elif kind == "ocr":
        rule = f"{clipped} OR (orientation = 'vertical' AND abs((p1+p3/2)-(q1+q3/2)) <= 0.5*least(p3,q3) AND least(p3,q3)/greatest(p3,q3,1e-6) >= 0.6::DOUBLE AND greatest(q0-(p0+p2), p0-(q0+q2)) <= 24)"
    else:
        ang = lambda s: f"((degrees(atan2({s}3-{s}1, {s}2-{s}0)) % 180) + 180) % 180"
        d = f"(abs(({ang('p')}) - ({ang('q')})) % 180)"
        line = lambda x, y: f"abs((p3-p1)*{x} - (p2-p0)*{y} + p2*p1 - p3*p0) / sqrt((p2-p0)*(p2-p0)+(p3-p1)*(p3-p1))"

        def gap(x: str, y: str, s: str) -> str:
            t = f"greatest(0, least(1, (({x}-{s}0)*({s}2-{s}0)+({y}-{s}1)*({s}3-{s}1))/(({s}2-{s}0)*({s}2-{s}0)+({s}3-{s}1)*({s}3-{s}1))))"
            return f"sqrt(({x}-({s}0+{t}*({s}2-{s}0)))*({x}-({s}0+{t}*({s}2-{s}0)))+({y}-({s}1+{t}*({s}3-{s}1)))*({y}-({s}1+{t}*({s}3-{s}1))))"

        rule = f"least({d}, 180-{d}) <= 5 AND greatest({line('q0', 'q1')}, {line('q2', 'q3')}) <= 6 AND least({gap('p0', 'p1', 'q')}, {gap('p2', 'p3', 'q')}, {gap('q0', 'q1', 'p')}, {gap('q2', 'q3', 'p')}) <= 24"
    return f"{near(kind, page)}, {pairs}, e AS (SELECT page, pair_ord, src, dst FROM ab WHERE {rule})"


def members(kind: str, page: str = PAGE) -> str:
    """m: candidates with root. Needs WITH RECURSIVE."""
    return f"""{edges(kind, page)},
b AS (SELECT page, src AS u, dst AS v FROM e UNION SELECT page, dst, src FROM e),
r(page, u, l) AS (SELECT page, u, u FROM b UNION SELECT b.page, b.v, r.l FROM r JOIN b ON r.page = b.page AND r.u = b.u WHERE r.l < b.v),
lab AS (SELECT page, u, min(l) AS root FROM r GROUP BY page, u),
m AS (SELECT c.*, coalesce(lab.root, c.uid) AS root FROM c LEFT JOIN lab ON c.page = lab.page AND c.uid = lab.u)"""


VOTE = """
v0 AS (SELECT page, root, label, sum(coalesce(confidence, 0.5)::DECIMAL(18,6)) AS score, min(ord) AS first FROM m GROUP BY page, root, label),
v AS (SELECT page, root, label FROM v0 QUALIFY row_number() OVER (PARTITION BY page, root ORDER BY score DESC, length(label) DESC, first) = 1)"""
FUSED = """min(ord) AS group_ord, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(tile_id))), ',') AS source_tiles, count(*) AS members"""

_OBJECTS = """
f AS (SELECT page, root, min(g0) AS g0, min(g1) AS g1, max(g0+g2)-min(g0) AS g2, max(g1+g3)-min(g1) AS g3, FUSED FROM m GROUP BY page, root)
SELECT f.page, f.root, g0, g1, g2, g3, v.label, confidence, source_tiles, members FROM f JOIN v USING (page, root)"""
_OBJECTS = _OBJECTS.replace("FUSED", FUSED)
MERGE_OBJECTS = f"WITH RECURSIVE {members('object')}, {VOTE}, {_OBJECTS}"
LAYOUT_MERGE = f"WITH RECURSIVE {members('object', OWN)}, {VOTE}, {_OBJECTS}"

MERGE_ARROWS = f"""WITH RECURSIVE {members('arrow')}, {VOTE},
ref AS (SELECT page, root, g0 AS r0, g1 AS r1, g2 AS r2, g3 AS r3 FROM m
  QUALIFY row_number() OVER (PARTITION BY page, root ORDER BY sqrt((g2-g0)*(g2-g0)+(g3-g1)*(g3-g1)) DESC, ord) = 1),
pts AS (SELECT page, root, g0 AS x, g1 AS y FROM m UNION ALL SELECT page, root, g2, g3 FROM m),
pr AS (SELECT page, root, x, y, (x-r0)*((r2-r0)/sqrt((r2-r0)*(r2-r0)+(r3-r1)*(r3-r1))) + (y-r1)*((r3-r1)/sqrt((r2-r0)*(r2-r0)+(r3-r1)*(r3-r1))) AS p
  FROM pts JOIN ref USING (page, root)),
lo AS (SELECT page, root, x, y FROM pr QUALIFY row_number() OVER (PARTITION BY page, root ORDER BY p, x, y) = 1),
hi AS (SELECT page, root, x, y FROM pr QUALIFY row_number() OVER (PARTITION BY page, root ORDER BY p DESC, x DESC, y DESC) = 1),
f AS (SELECT page, root, first(g0 ORDER BY ord) AS s0, first(g1 ORDER BY ord) AS s1, first(g2 ORDER BY ord) AS s2, first(g3 ORDER BY ord) AS s3, {FUSED} FROM m
  GROUP BY page, root)
SELECT f.page, f.root, round(CASE WHEN members = 1 THEN s0 ELSE lo.x END, 6) AS g0, round(CASE WHEN members = 1 THEN s1
  ELSE lo.y END, 6) AS g1, round(CASE WHEN members = 1 THEN s2 ELSE hi.x END, 6) AS g2, round(CASE WHEN members = 1 THEN s3
    ELSE hi.y END, 6) AS g3, v.label, confidence, source_tiles, members
FROM f JOIN v USING (page, root) JOIN lo ON f.page = lo.page AND f.root = lo.root JOIN hi ON f.page = hi.page AND f.root = hi.root"""

TEXT_GROUPS = f"""WITH RECURSIVE {members('ocr')}
SELECT page, root, min(g0) AS g0, min(g1) AS g1, max(g0+g2)-min(g0) AS g2, max(g1+g3)-min(g1) AS g3, max(confidence) AS confidence, count(*) AS members FROM m
  GROUP BY page, root"""

def _md5(text: str) -> str:
    """The md5 of a text, as a 128-bit number, modulo 1000."""
    half = lambda at: f"('0x' || substr(md5({text}), {at}, 16))::UBIGINT % 1000"
    return f"CAST((({half(1)}) * 616 + {half(17)}) % 1000 AS BIGINT)"


#: Fragments in reading order, folded into one text.
FOLD = """
fm AS (SELECT page, root, bool_and(g3 > 2*g2) AS upright, min(g0) AS b0, min(g1) AS b1, max(g0+g2)-min(g0) AS b2, max(g1+g3)-min(g1) AS b3, min(ord) AS group_ord, max(confidence) AS confidence,
         array_to_string(list_sort(list_distinct(list(tile_id))), ',') AS source_tiles, count(*) AS members,
         list({'g0': g0, 'g1': g1, 'g2': g2, 'g3': g3, 'label': label} ORDER BY g1, g0, ord) AS down, list({'g0': g0, 'g1': g1, 'g2': g2, 'g3': g3, 'label': label} ORDER BY g0, g1, ord) AS across
       FROM m GROUP BY page, root),
ft AS (SELECT *, list_reduce(CASE WHEN upright THEN down ELSE across END, lambda a, x: {
         'g0': least(a.g0, x.g0), 'g1': least(a.g1, x.g1), 'g2': greatest(a.g0+a.g2, x.g0+x.g2)-least(a.g0, x.g0), 'g3': greatest(a.g1+a.g3, x.g1+x.g3)-least(a.g1, x.g1),
         'label': CASE WHEN a.label = '' THEN x.label WHEN contains(a.label, x.label) THEN a.label WHEN contains(x.label, a.label) THEN x.label
           WHEN len(list_filter(range(2, least(length(a.label), length(x.label))), lambda k: right(a.label, k) = left(x.label, k))) > 0
             THEN a.label || substr(x.label, list_max(list_filter(range(2, least(length(a.label), length(x.label))), lambda k: right(a.label, k) = left(x.label, k))) + 1)
           WHEN least(a.g0+a.g2, x.g0+x.g2) > greatest(a.g0, x.g0) AND least(a.g1+a.g3, x.g1+x.g3) > greatest(a.g1, x.g1)
             AND (least(a.g0+a.g2, x.g0+x.g2)-greatest(a.g0, x.g0))*(least(a.g1+a.g3, x.g1+x.g3)-greatest(a.g1, x.g1)) >= 0.6::DOUBLE*least(a.g2*a.g3, x.g2*x.g3)
             THEN CASE WHEN length(x.label) > length(a.label) THEN x.label ELSE a.label END
           ELSE a.label || ' ' || x.label END}).label AS label FROM fm)"""
MERGE_TEXT = f"""WITH RECURSIVE {members('ocr')}, {FOLD} SELECT page, root, b0 AS g0, b1 AS g1, b2 AS g2, b3 AS g3, label, confidence, source_tiles, members
  FROM ft"""


def _placed(kind: str, body: str) -> str:
    rounded = ", ".join(f"round(g{i}, 6) AS g{i}" for i in range(4))
    return f"(SELECT page, '{kind}' AS kind, row_number() OVER (PARTITION BY page ORDER BY g1, g0, group_ord) AS place, {rounded}, label, confidence, members FROM ({body}))"


MERGED_PAGES = " UNION ALL ".join((
    _placed("object", MERGE_OBJECTS.replace("SELECT f.page, f.root,", "SELECT f.page, f.root, f.group_ord,")),
    _placed("arrow", MERGE_ARROWS.replace("SELECT f.page, f.root,", "SELECT f.page, f.root, f.group_ord,")),
    _placed("ocr", MERGE_TEXT.replace("SELECT page, root, b0", "SELECT page, root, group_ord, b0")),
))

#: A drawing size for each page, and how it fits the canvas.
FIT = """
pg AS (SELECT DISTINCT event_id // 25 AS page FROM events),
f0 AS (SELECT page, 900 + (page * 37) % 5000 AS orig_w, 700 + (page * 91) % 4000 AS orig_h FROM pg),
f1 AS (SELECT *, orig_h > orig_w AS rotated, greatest(orig_w, orig_h) AS w, least(orig_w, orig_h) AS h FROM f0),
f2 AS (SELECT *, least(4096.0::DOUBLE/w, 2896.0::DOUBLE/h) AS scale FROM f1),
fit AS (SELECT page, orig_w, orig_h, rotated, scale, floor((4096 - greatest(1, CAST(round_even(w*scale, 0) AS INTEGER)))/2.0) AS pad_x, floor((2896 - greatest(1, CAST(round_even(h*scale, 0) AS INTEGER)))/2.0) AS pad_y FROM f2)"""


def _back(x: str, y: str) -> tuple[str, str]:
    px, py = f"(({x}-pad_x)/scale)", f"(({y}-pad_y)/scale)"
    return f"(CASE WHEN rotated THEN {py} ELSE {px} END)", f"(CASE WHEN rotated THEN orig_h-1-{px} ELSE {py} END)"


def _original() -> str:
    a, b = _back("x", "y"), _back("x+w", "y+h")
    c, d = _back("x1", "y1"), _back("x2", "y2")
    box = f"round(least({a[0]},{b[0]}), 6) AS g0, round(least({a[1]},{b[1]}), 6) AS g1, round(abs({a[0]}-{b[0]}), 6) AS g2, round(abs({a[1]}-{b[1]}), 6) AS g3"
    line = f"round({c[0]}, 6) AS g0, round({c[1]}, 6) AS g1, round({d[0]}, 6) AS g2, round({d[1]}, 6) AS g3"
    rows = lambda kind, g: f"(WITH {truth(kind)}, {FIT} SELECT page, id, '{kind}' AS kind, {g} FROM tru JOIN fit USING (page))"
    return f"{rows('object', box)} UNION ALL {rows('ocr', box)} UNION ALL {rows('arrow', line)}"


def _page_items() -> str:
    """The items of documents; format() rounds by the exact value of a double, ties to even."""
    a, b = _back("g0", "g1"), _back("g0+g2", "g1+g3")
    c, d = _back("g0", "g1"), _back("g2", "g3")
    shown = lambda *v: ", ".join(f"CAST(format('{{:.1f}}', {x}) AS DOUBLE) AS o{i}" for i, x in enumerate(v))
    box = shown(f"least({a[0]},{b[0]})", f"least({a[1]},{b[1]})", f"greatest({a[0]},{b[0]})-least({a[0]},{b[0]})", f"greatest({a[1]},{b[1]})-least({a[1]},{b[1]})")
    line = shown(c[0], c[1], d[0], d[1])
    first = lambda body: body.replace("round(CASE WHEN members = 1 THEN s", "(CASE WHEN members = 1 THEN s").replace(" END, 6) AS g", " END) AS g")
    bodies = (
        ("object", box, MERGE_OBJECTS.replace("SELECT f.page, f.root,", "SELECT f.page, f.root, f.group_ord,")),
        ("ocr", box, MERGE_TEXT.replace("SELECT page, root, b0", "SELECT page, root, group_ord, b0")),
        ("arrow", line, first(MERGE_ARROWS.replace("SELECT f.page, f.root,", "SELECT f.page, f.root, f.group_ord,"))),
    )
    rounded = ", ".join(f"round(g{i}, 6) AS g{i}" for i in range(4))
    return " UNION ALL ".join(f"""(SELECT page, '{kind}' AS kind, row_number() OVER (PARTITION BY page ORDER BY g1, g0, group_ord) - 1 AS place, {rounded}, {shape}, label,
      CAST(format('{{:.4f}}', confidence) AS DOUBLE) AS confidence, source_tiles FROM ({body}) JOIN (WITH {FIT} SELECT * FROM fit) USING (page))""" for kind, shape, body in bodies)


def _page_result() -> str:
    kept = " UNION ALL ".join(f"(WITH {sliced(k)} SELECT page, tile_id, '{k}' AS kind FROM sl WHERE confidence >= {LEAST[k]}::DOUBLE)" for k in RANK)
    groups = " UNION ALL ".join(f"(WITH RECURSIVE {members(k)} SELECT page, '{k}' AS kind, root FROM m GROUP BY ALL)" for k in RANK)
    sides = " UNION ALL ".join(f"(WITH {near(k)} SELECT page, pair_ord, side FROM n GROUP BY ALL)" for k in RANK)
    return f"""WITH pg AS (SELECT DISTINCT event_id // 25 AS page FROM events), d AS ({kept}), g AS ({groups}), sd AS ({sides}),
      t AS (SELECT page, count(DISTINCT tile_id) AS tiles, count(*) AS items FROM d GROUP BY page),
      c AS (SELECT page, count(*) FILTER (kind = 'object') AS objects, count(*) FILTER (kind = 'ocr') AS texts, count(*) FILTER (kind = 'arrow') AS arrows FROM g
      GROUP BY page),
      pr AS (SELECT page, count(*) AS pairs FROM (SELECT page, pair_ord FROM sd GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY page)
      SELECT page, tiles, items, objects, texts, arrows, CASE WHEN objects > 0
      THEN 4::BIGINT END AS corners, coalesce(pairs, 0) AS pairs, 0::BIGINT AS llm_calls
      FROM pg LEFT JOIN t USING (page) LEFT JOIN c USING (page) LEFT JOIN pr USING (page)"""


def _datasets() -> str:
    found = " UNION ALL ".join(f"(WITH {sliced(k)} SELECT 'P' || page AS image_id, tile_id, '{k}' AS kind FROM sl)" for k in RANK)
    return f"""WITH {GRID}, d AS ({found}),
      im AS (SELECT DISTINCT 'P' || ((event_id // 25) * 2) AS image_id FROM events UNION SELECT image_id FROM d),
      sp AS (SELECT image_id, {_md5("image_id")} AS r FROM im),
      s AS (SELECT image_id, CASE WHEN r < 800 THEN 'train' WHEN r < 900 THEN 'valid' ELSE 'test' END AS split FROM sp),
      k AS (SELECT image_id, tile_id, count(*) FILTER (kind = 'object') AS n_lines, count(*) FILTER (kind = 'arrow') AS n_coco, count(*) FILTER (kind = 'ocr') AS n_crops FROM d
      GROUP BY ALL),
      t AS (SELECT i.image_id, grid.tile_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_coco, 0) AS n_coco, coalesce(n_crops, 0) AS n_crops
            FROM (SELECT DISTINCT image_id FROM d) i CROSS JOIN grid LEFT JOIN k ON k.image_id = i.image_id AND k.tile_id = grid.tile_id),
      u AS (SELECT * FROM t WHERE n_lines + n_coco + n_crops > 0 OR {_md5("image_id || '/' || tile_id")} < 200)
      SELECT split, image_id || '_' || tile_id AS name, n_lines, n_coco, n_crops, 1024 AS width, row_number() OVER (PARTITION BY split ORDER BY image_id, tile_id) - 1 AS coco_id FROM u
      JOIN s USING (image_id)"""


#: One profile per user and day: classes are event types, tiles are hours with events.
PROFILES = """
d AS (SELECT user_id % 10 AS job, CAST(ts AS DATE) AS day, event_type AS label, CAST((event_id*37)%100 AS DOUBLE)/100 AS confidence, hour(ts) AS hr
  FROM events),
k AS (SELECT job, day, label, count(*) AS n FROM d GROUP BY ALL),
p AS (SELECT job, day, count(DISTINCT hr) AS n_tiles, count(*) AS n, avg(confidence) AS mean_confidence FROM d GROUP BY ALL)"""


def _drawn(what: str, low: int, high: int, *at: str) -> str:
    key = " || '-' || ".join(["'7'", f"'{what}'", "drawing", *at])
    return f"CAST({low} + ('0x' || substr(md5({key}), 1, 12))::BIGINT % {high - low + 1} AS INTEGER)"


#: walked: for each part, with item = k at the end, the components placed so far; each takes the first of 30 tries that is free.
_PLACED = f"""
wanted AS (SELECT p_partkey AS drawing, {_drawn('n', 6, 12).replace('drawing', 'p_partkey')} AS k FROM part),
walked AS (
  SELECT drawing, k, 0 AS item, CAST([] AS STRUCT(item INTEGER, x INTEGER, y INTEGER, w INTEGER, h INTEGER, c INTEGER)[]) AS done FROM wanted
  UNION ALL
  SELECT drawing, k, item, CASE WHEN t IS NULL THEN done ELSE list_append(done, {{'item': item, 'x': t.x, 'y': t.y, 'w': w, 'h': h, 'c': c}}) END FROM (
    SELECT drawing, k, item, done, w, h, c, list_filter(list_transform(range(1, 31), lambda n: {{'x': {_drawn('x', 200, 2308, 'item', 'n')}, 'y': {_drawn('y', 250, 1880, 'item', 'n')}}}),
        lambda t: len(list_filter(done, lambda a: NOT (t.x + w + 160 < a.x OR a.x + a.w + 160 < t.x OR t.y + h + 160 < a.y OR a.y + a.h + 160 < t.y))) = 0)[1] AS t FROM (
      SELECT drawing, k, item, done, c, CASE WHEN c = 1 THEN least(w0, h0) ELSE w0 END AS w, CASE WHEN c = 1 THEN least(w0, h0) ELSE h0 END AS h FROM (
        SELECT drawing, k, item, done, {_drawn('class', 0, 2, 'item')} AS c, {_drawn('w', 180, 620, 'item')} AS w0, {_drawn('h', 180, 520, 'item')} AS h0
        FROM (SELECT drawing, k, item + 1 AS item, done FROM walked WHERE item < k))))
)"""


#: A sheet for each part, with the starts of its tiles, and the tiles.
_SHEETS = """
sized AS (SELECT p_partkey AS page, CAST(300 + p_size * 97 AS INTEGER) AS width, CAST(200 + (p_partkey % 90) * 53 AS INTEGER) AS height FROM part),
sheets AS (SELECT *, CASE WHEN width <= 1024 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, width - 1024, 896), width - 1024))) END AS xs,
  CASE WHEN height <= 1024 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, height - 1024, 896), height - 1024))) END AS ys FROM sized)"""
_SHEET_TILES = """
tiles AS MATERIALIZED (SELECT page, r * len(xs) + c AS idx, printf('Tile_%03d', r * len(xs) + c + 1) AS tile_id, xs[c + 1]::DOUBLE AS tx, ys[r + 1]::DOUBLE AS ty,
    least(1024, width - xs[c + 1])::DOUBLE AS tw, least(1024, height - ys[r + 1])::DOUBLE AS th
  FROM (SELECT *, unnest(range(len(xs))) AS c FROM (SELECT *, unnest(range(len(ys))) AS r FROM sheets)))"""


ORACLES: dict[str, str] = {
    "tile_starts": f"WITH {_SHEETS} SELECT page, width, array_to_string(xs, ',') AS starts FROM sheets",
    "tile_grid": f"WITH {_SHEETS}, {_SHEET_TILES} SELECT page, CAST(idx AS INTEGER) AS idx, tile_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CAST(tw AS INTEGER) AS tw, CAST(th AS INTEGER) AS th FROM tiles",
    "tile_pairs": f"WITH {_SHEETS}, {_SHEET_TILES}, {LAYOUT_PAIRS} SELECT *, o0-48 AS s0, o1-48 AS s1, o2+96 AS s2, o3+96 AS s3 FROM pairs",
    "canvas_fit": """WITH t AS (SELECT p_partkey AS page, p_size*97 AS orig_w, (p_partkey % 90 + 1)*53 AS orig_h FROM part),
      u AS (SELECT *, orig_h > orig_w AS rotated, greatest(orig_w, orig_h) AS w, least(orig_w, orig_h) AS h FROM t),
      v AS (SELECT *, least(4096.0::DOUBLE/w, 2896.0::DOUBLE/h) AS scale FROM u),
      x AS (SELECT *, greatest(1, CAST(round_even(w*scale, 0) AS INTEGER)) AS new_w, greatest(1, CAST(round_even(h*scale, 0) AS INTEGER)) AS new_h FROM v)
      SELECT page, rotated, scale, new_w, new_h, CAST(floor((4096-new_w)/2.0) AS INTEGER) AS pad_x, CAST(floor((2896-new_h)/2.0) AS INTEGER) AS pad_y FROM x""",
    "coords_round_trip": "SELECT p_partkey AS page, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 31 AS DOUBLE) AS y FROM part",
    "box_iou_pairs": f"""WITH {truth('object')}, z AS (SELECT a.id AS a, b.id AS b, {_iou('a.g', 'b.g')} AS iou
      FROM (SELECT id, page, x AS g0, y AS g1, w AS g2, h AS g3 FROM tru) a JOIN (SELECT id, page, x AS g0, y AS g1, w AS g2, h AS g3
      FROM tru) b ON a.page = b.page AND a.id < b.id) SELECT a, b, iou FROM z WHERE iou > 0""",
    "segment_box_codec": f"""WITH {truth('arrow')} SELECT id, CASE WHEN w >= 3*h THEN 'level' WHEN h >= 3*w THEN 'upright'
      ELSE 'diagonal' END AS form, x1 AS s0, (y1+y2)/2 AS s1, x2 AS s2, (y1+y2)/2 AS s3 FROM (SELECT *, x2-x1+8 AS w, y2-y1+8 AS h FROM tru)""",
    "slice_objects": f"WITH {sliced('object')} SELECT page, id, tile_id, item_idx, g0, g1, g2, g3, label FROM sl",
    "slice_text": f"WITH {sliced('ocr')} SELECT page, id, tile_id, item_idx, g0, g1, g2, g3, label FROM sl",
    "slice_arrows": f"""WITH {sliced('arrow')} SELECT page, id, tile_id, item_idx, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2, round(g3, 6) AS g3, label
      FROM sl""",
    "apply_thresholds": f"""SELECT kind, sum(n)::BIGINT AS n FROM ({' UNION ALL '.join(f'''(WITH {sliced(k)} SELECT '{k}' AS kind, count(*) AS n
      FROM sl WHERE confidence >= {LEAST[k]}::DOUBLE)''' for k in RANK)}) GROUP BY kind""",
    "seam_candidates": f"WITH {near('object')} SELECT CAST(pair_ord AS INTEGER) AS pair_ord, side, count(*) AS n FROM n GROUP BY ALL",
    "active_pairs": f"WITH {near('object')} SELECT page, CAST(pair_ord AS INTEGER) AS pair_ord FROM n GROUP BY ALL HAVING count(DISTINCT side) = 2",
    "match_objects": f"WITH {edges('object')} SELECT page, CAST(pair_ord AS INTEGER) AS pair_ord, src, dst FROM e",
    "match_arrows": f"WITH {edges('arrow')} SELECT page, CAST(pair_ord AS INTEGER) AS pair_ord, src, dst FROM e",
    "match_objects_dense": f"WITH {edges('object', DENSE)} SELECT page, CAST(pair_ord AS INTEGER) AS pair_ord, src, dst FROM e",
    "match_text": f"WITH {edges('ocr')} SELECT page, CAST(pair_ord AS INTEGER) AS pair_ord, src, dst FROM e",
    "components": f"WITH RECURSIVE {members('object')} SELECT page, u AS uid, root FROM lab",
    "merge_objects": MERGE_OBJECTS,
    "merge_arrows": MERGE_ARROWS,
    "text_groups": TEXT_GROUPS,
    "class_vote": f"WITH RECURSIVE {members('object')}, {VOTE} SELECT page, root, label FROM v",
    "merge_report": f"""WITH RECURSIVE {members('object')}, g AS (SELECT page, root, count(*) AS k FROM m GROUP BY ALL), a AS (SELECT page, pair_ord
      FROM n GROUP BY ALL HAVING count(DISTINCT side) = 2) SELECT page, coalesce((SELECT count(*) FROM a
      WHERE a.page = g.page), 0) AS pairs, count(*) FILTER (k > 1) AS merged_groups FROM g GROUP BY page""",
    "page_counts": f"""SELECT page, sum(o)::BIGINT AS objects, sum(t)::BIGINT AS ocr, sum(a)::BIGINT AS arrows FROM (
      (WITH {sliced('object')} SELECT page, 1 AS o, 0 AS t, 0 AS a FROM sl) UNION ALL (WITH {sliced('ocr')} SELECT page, 0, 1, 0 FROM sl)
      UNION ALL (WITH {sliced('arrow')} SELECT page, 0, 0, 1 FROM sl)) GROUP BY page""",
    "drift_profile": f"""WITH {PROFILES}, t AS (SELECT job, day, sum(n) AS total FROM k GROUP BY ALL)
      SELECT k.job, k.day, p.n_tiles, k.label, round(k.n/t.total, 9) AS share, round(p.n/p.n_tiles, 9) AS objects_per_tile, round(p.mean_confidence, 9) AS mean_confidence FROM k
      JOIN t USING (job, day) JOIN p USING (job, day)""",
    "average_profile": f"""WITH {PROFILES}, t AS (SELECT job, day, sum(n) AS total FROM k GROUP BY ALL),
      s AS (SELECT k.job, k.label, sum(k.n/t.total) AS v FROM k JOIN t USING (job, day) GROUP BY ALL),
      b AS (SELECT job, count(*) AS c, sum(n_tiles)::BIGINT AS n_tiles, avg(n/n_tiles) AS objects_per_tile FROM p GROUP BY job)
      SELECT s.job, n_tiles, label, round(v/c, 9) AS share, round(objects_per_tile, 9) AS objects_per_tile FROM s JOIN b USING (job)""",
    "drift_compare": f"""WITH {PROFILES}, t AS (SELECT job, day, sum(n) AS total FROM k GROUP BY ALL),
      sh AS (SELECT k.job, k.day, k.label, k.n/t.total AS v FROM k JOIN t USING (job, day)),
      b AS (SELECT job, label, sum(v) AS v FROM sh GROUP BY ALL), c AS (SELECT job, count(*) AS c, avg(n/n_tiles) AS r, avg(mean_confidence) AS m
      FROM p GROUP BY job),
      keys AS (SELECT p.job, p.day, l.label FROM p, (SELECT DISTINCT label FROM k) l),
      z AS (SELECT keys.job, keys.day, sum((greatest(coalesce(sh.v,0),1e-4)-greatest(coalesce(b.v/c.c,0),1e-4))*ln(greatest(coalesce(sh.v,0),1e-4)/greatest(coalesce(b.v/c.c,0),1e-4))) AS psi
            FROM keys JOIN c ON c.job = keys.job LEFT JOIN b ON b.job = keys.job AND b.label = keys.label LEFT
      JOIN sh ON sh.job = keys.job AND sh.day = keys.day AND sh.label = keys.label GROUP BY ALL),
      y AS (SELECT p.job, p.day, psi, abs(p.n/p.n_tiles-c.r)/greatest((p.n/p.n_tiles+c.r)/2, 1e-4) AS shift, greatest(0, c.m-p.mean_confidence) AS lost, p.job % 4 <> 3 AS known FROM p
      JOIN z USING (job, day) JOIN c USING (job))
      SELECT job, day, CASE WHEN known THEN round(psi, 7) END AS object_class_psi, CASE WHEN known THEN 0.0::DOUBLE END AS arrow_class_psi, CASE
      WHEN known THEN round(shift, 7) END AS objects_per_tile_shift,
             CASE WHEN known THEN 0.0::DOUBLE END AS arrows_per_tile_shift, CASE WHEN known THEN 0.0::DOUBLE END AS ocr_per_tile_shift, CASE
      WHEN known THEN round(lost, 7) END AS confidence_drop,
             known AND (psi > 0.25 OR shift > 1 OR lost > 0.15::DOUBLE) AS drift, CASE WHEN known THEN 'ok' ELSE 'no_baseline' END AS status,
             CASE WHEN known THEN concat_ws(',', CASE WHEN psi > 0.25 THEN 'object_class_psi' END, CASE WHEN shift > 1
      THEN 'objects_per_tile_shift' END, CASE WHEN lost > 0.15::DOUBLE THEN 'confidence_drop' END) ELSE '' END AS flags FROM y""",
    "rolling_baseline": f"""WITH {PROFILES} SELECT job, day, round(avg(n/n_tiles) OVER (PARTITION BY job ORDER BY day ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 9) AS base
      FROM p""",
    "recent_profiles": f"WITH {PROFILES} SELECT job, day, n_tiles FROM (SELECT * FROM p ORDER BY day DESC, job LIMIT 50) WHERE n_tiles > 0",
    "latest_baseline": """SELECT event_type AS name, max(ts) AS created_at, arg_max(value, ts) AS profile
      FROM (SELECT event_type, ts, max(value) AS value FROM events GROUP BY ALL) GROUP BY event_type""",
    "split_assignment": """WITH h AS (SELECT DISTINCT p_name || '_' || p_partkey AS image_id, md5(p_name || '_' || p_partkey) AS m FROM part),
      r AS (SELECT image_id, ((('0x' || substr(m, 1, 16))::UBIGINT % 1000) * 616 + ('0x' || substr(m, 17, 16))::UBIGINT % 1000) % 1000 AS r FROM h)
      SELECT image_id, CASE WHEN r < 800 THEN 'train' WHEN r < 900 THEN 'valid' ELSE 'test' END AS split FROM r""",
    "class_index": """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS yolo, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS coco
      FROM (SELECT DISTINCT p_type AS label FROM part)""",
    "yolo_labels": f"""WITH {sliced('object')}, i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label
      FROM sl)) SELECT page, tile_id, item_idx, CAST(i.idx AS INTEGER) AS idx, (g0+g2/2)/1024 AS cx, (g1+g3/2)/1024 AS cy, g2/1024 AS rw, g3/1024 AS rh FROM sl
      JOIN i USING (label)""",
    "coco_annotations": f"""WITH {sliced('arrow')}, i AS (SELECT label, row_number() OVER (ORDER BY label) AS idx FROM (SELECT DISTINCT label FROM sl)),
      z AS (SELECT ['train', 'valid', 'test'][page % 3 + 1] AS split, page, tile_id, item_idx, i.idx, greatest(0, least(g0,g2)-4) AS x, greatest(0, least(g1,g3)-4) AS y, greatest(g0,g2)-least(g0,g2)+8 AS w, greatest(g1,g3)-least(g1,g3)+8 AS h FROM sl JOIN i USING (label))
      SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY page, tile_id, item_idx) - 1 AS BIGINT) AS id, page, tile_id, item_idx, CAST(idx AS INTEGER) AS category_id, round(x, 6) AS x, round(y, 6) AS y, round(least(w, 1024-x), 6) AS w, round(least(h, 1024-y), 6) AS h FROM z""",
    "ocr_crops": f"""WITH {sliced('ocr')}
      SELECT page, tile_id, item_idx, CAST(greatest(0, g0-3) AS BIGINT) AS x0, CAST(greatest(0, g1-3) AS BIGINT) AS y0, CAST(least(1024, g0+g2+3) AS BIGINT) AS x1, CAST(least(1024, g1+g3+3) AS BIGINT) AS y1 FROM sl""",
    "manifest": f"""WITH o AS (WITH {sliced('object')} SELECT label, count(*) AS n FROM sl GROUP BY label), a AS (WITH {sliced('arrow')}
      SELECT label, count(*) AS n FROM sl GROUP BY label), t AS (WITH {sliced('ocr')} SELECT count(*) AS n FROM sl)
      SELECT (SELECT string_agg(label, ',' ORDER BY label) FROM o) AS object_classes, (SELECT string_agg(label, ',' ORDER BY label) FROM a) AS arrow_classes,
             (SELECT string_agg(label || '=' || n, ',' ORDER BY label)
      FROM o) AS object_class_counts, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM a) AS arrow_class_counts,
             (SELECT sum(n) FROM o)::BIGINT AS objects, (SELECT n FROM t)::BIGINT AS texts, (SELECT sum(n) FROM a)::BIGINT AS arrows, ((SELECT sum(n)
      FROM o)+(SELECT sum(n) FROM a)+(SELECT n FROM t))::BIGINT AS items""",
    "ocr_cer": """SELECT round(sum(levenshtein(truth, read)) / sum(greatest(1, length(truth))), 9) AS cer, round(avg((truth = read)::INTEGER), 9) AS exact, count(*) AS n
      FROM (SELECT p_name AS truth, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_type, 'A', 'E') END AS read FROM part)""",
    "champion_promotion": """SELECT model, version, metric, coalesce(metric > max(metric) OVER w, max(metric) OVER w IS NULL) AS promoted
      FROM (SELECT c_nationkey AS model, c_custkey AS version, c_acctbal AS metric
      FROM customer) WINDOW w AS (PARTITION BY model ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "word_lines": """SELECT page, par, line, min(lft) AS x, min(top) AS y, max(lft+width)-min(lft) AS w, max(top+height)-min(top) AS h, array_to_string(list(txt ORDER BY lft, top, txt), ' ') AS text, round(avg(conf)/100, 9) AS confidence
      FROM (SELECT event_id % 40 AS page, event_id % 3 AS par, event_id % 11 AS line, (event_id*37) % 2000 AS lft, (event_id*13) % 9 AS top, 20 + event_id % 50 AS width, 12 AS height, event_id % 101 - 1 AS conf, event_type AS txt FROM events) WHERE conf >= 0 GROUP BY page, par, line""",
    "hough_topk": """SELECT tile, ord, round(least(0.95::DOUBLE, 0.3::DOUBLE + len/1448.0::DOUBLE), 9) AS score
      FROM (SELECT event_id % 7 AS tile, event_id AS ord, CAST((event_id*7919) % 1400 AS DOUBLE) AS len, row_number() OVER (PARTITION BY event_id % 7 ORDER BY (event_id*7919) % 1400 DESC, event_id) AS rk FROM events) WHERE rk <= 150""",
    "contour_gate": """SELECT id, round(least(0.99::DOUBLE, 0.4::DOUBLE + 0.5::DOUBLE*(area/(w*h))), 9) AS score
      FROM (SELECT event_id AS id, CAST(10 + event_id % 700 AS DOUBLE) AS w, CAST(10 + (event_id*7) % 700 AS DOUBLE) AS h, CAST((10 + event_id % 700)*(10 + (event_id*7) % 700) AS DOUBLE) * ((event_id % 100) / 100.0::DOUBLE) AS area FROM events) WHERE w*h >= 0.004::DOUBLE*1048576 AND w*h <= 0.6::DOUBLE*1048576 AND least(w,h) >= 24 AND area/(w*h) >= 0.15::DOUBLE""",
    "text_gate": """SELECT id FROM (SELECT event_id AS id, event_id % 400 AS w, event_id % 110 AS h, (event_id % 100)/100.0::DOUBLE AS density
      FROM events) WHERE h BETWEEN 6 AND 90 AND w >= 6 AND w <= 25*h AND density >= 0.08::DOUBLE AND density <= 0.7::DOUBLE""",
    "recent_jobs": """SELECT job_id, status, created_at FROM (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O'
      THEN 'queued' ELSE 'running' END AS status, o_orderdate AS created_at FROM orders)
      WHERE status = 'succeeded' ORDER BY created_at DESC, job_id LIMIT 20""",
    "job_state": """WITH e AS (SELECT event_id % 500 AS job_id, ts, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2
      THEN 'succeeded' ELSE 'failed' END AS status, event_id % 4 AS rk FROM events)
      SELECT job_id, arg_max(status, ts::VARCHAR || rk) AS status, min(ts) AS created_at FROM e GROUP BY job_id""",
    "request_log_summary": """SELECT path, status_code, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, max(latency_ms) AS slowest_ms
      FROM (SELECT CASE event_id % 5 WHEN 0 THEN '/healthz' ELSE '/v1/' || event_type END AS path, CASE WHEN event_id % 17 = 0 THEN 500
      ELSE 200 END AS status_code, value AS latency_ms FROM events) WHERE path NOT IN ('/healthz', '/readyz') GROUP BY path, status_code""",
    "feedback_valid": """SELECT id FROM (SELECT event_id AS id, event_id % 3000 AS job_id, CASE WHEN event_id % 7 = 0 THEN NULL
      ELSE event_id % 8 END AS rating FROM events) f WHERE (rating IS NULL OR rating BETWEEN 1 AND 5) AND (id % 11 = 0 OR 4990 + id % 20 <= 5000) AND EXISTS (SELECT 1 FROM orders
      WHERE o_orderkey = f.job_id)""",
    "upload_validation": """SELECT page_id, CASE WHEN NOT regexp_matches(lower(name), '\\.(png|jpg|jpeg|bmp|tif|tiff|webp|pdf)$') THEN 415
      WHEN size = 0 THEN 400 WHEN size > 52428800 THEN 413 ELSE 202 END AS code FROM (SELECT page_id, 'drawing_' || page_id || CASE page_id % 4 WHEN 0
      THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' ELSE '.tiff' END AS name, (page_id % 5) * 20000000 AS size FROM pages)""",
    "result_gate": """SELECT l_orderkey AS job_id, CASE WHEN o_orderkey IS NULL THEN 404 WHEN o_orderstatus <> 'F' THEN 409 WHEN l_orderkey % 5 = 0
      THEN 404 ELSE 200 END AS code FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders
      WHERE o_orderkey % 3 <> 0) ON l_orderkey = o_orderkey""",
    "text_join": """WITH p AS (SELECT event_id AS id, 'M' || (event_id % 97) || ' ' || event_type AS a, substr(event_type, CAST(event_id % 4 AS INTEGER) + 1) || '-' || (event_id % 7) AS b FROM events),
      k AS (SELECT *, list_max(list_filter(range(2, least(length(a), length(b))), lambda k: right(a, k) = left(b, k))) AS k FROM p)
      SELECT id, CASE WHEN contains(a, b) THEN a WHEN contains(b, a) THEN b WHEN k IS NOT NULL THEN a || substr(b, k + 1)
      ELSE a || ' ' || b END AS joined FROM k""",
    "ascii_labels": """SELECT doc_id, regexp_replace(replace(replace(replace(text, 'Ø', 'D'), '±', '+-'), '°', 'deg'), '[^\\x00-\\x7F]', '?', 'g') AS label
      FROM documents""",
    "synthetic_drawings": f"""WITH RECURSIVE {_PLACED},
      i AS (SELECT drawing, unnest(done) AS p FROM walked WHERE item = k),
      b AS (SELECT drawing, p.item AS item, p.x::DOUBLE AS x, p.y::DOUBLE AS y, p.w::DOUBLE AS w, p.h::DOUBLE AS h, p.c AS c, {_drawn('line', 0, 2, 'p.item')} AS l, {_drawn('text', 0, 999, 'p.item')} AS d FROM i)
      SELECT drawing, item, 'object' AS kind, x AS g0, y AS g1, w AS g2, h AS g3, 'Ctype_' || (c + 1) AS label FROM b
      UNION ALL SELECT drawing, item, 'ocr', x, y - 40, 110, 28, 'Ø' || d FROM b
      UNION ALL SELECT drawing, item, 'arrow', x + w, y + h/2, x + w + 150, y + h/2 + (l - 1)*20, ['dimension_line', 'leader_line', 'section_arrow'][l + 1] FROM b""",
    "synthetic_distances": f"""WITH RECURSIVE {_PLACED},
      i AS (SELECT drawing, unnest(done) AS p FROM walked WHERE item = k),
      m AS (SELECT a.drawing, count(DISTINCT a.p.item) AS n FROM i a JOIN i b ON a.drawing = b.drawing AND a.p.item < b.p.item
        WHERE NOT (a.p.x + a.p.w + 160 < b.p.x OR b.p.x + b.p.w + 160 < a.p.x OR a.p.y + a.p.h + 160 < b.p.y OR b.p.y + b.p.h + 160 < a.p.y) GROUP BY a.drawing)
      SELECT drawing, len(done)::BIGINT AS components, coalesce(n, 0)::BIGINT AS too_near FROM walked LEFT JOIN m USING (drawing) WHERE item = k""",
    "empty_tiles": f"""WITH {GRID}, t AS (SELECT CAST(p_partkey AS VARCHAR) AS image_id, tile_id FROM part, grid),
      h AS (SELECT DISTINCT CAST(event_id % 900 + 1 AS VARCHAR) AS image_id, printf('Tile_%03d', event_id % 13 + 1) AS tile_id FROM events)
      SELECT image_id, tile_id FROM t WHERE EXISTS (SELECT 1 FROM h
      WHERE h.image_id = t.image_id AND h.tile_id = t.tile_id) OR {_md5("image_id || '/' || tile_id")} < 200""",
    "resolve_models": "SELECT c_nationkey AS model, c_mktsegment AS alias, max(c_custkey) AS version FROM customer WHERE c_acctbal > 0 GROUP BY ALL",
    "last_metrics": """SELECT user_id AS run, CAST(regexp_extract(arg_max(props, event_id), '[0-9]+') AS DOUBLE) AS value FROM events
      WHERE event_id % 3 <> 0 GROUP BY user_id""",
    "state_upsert": "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 10 = 0 THEN 'archived' ELSE o_orderstatus END AS status FROM orders",
    "merge_text": MERGE_TEXT,
    "merged_pages": MERGED_PAGES,
    "original_coords": _original(),
    "canvas_coords": f"""WITH {FIT}, q AS (SELECT *, CAST(page % 89 AS DOUBLE) AS x, CAST(page % 53 AS DOUBLE) AS y FROM fit)
      SELECT page, round((CASE WHEN rotated THEN orig_h-1-y ELSE x END)*scale+pad_x, 6) AS x, round((CASE WHEN rotated THEN x
      ELSE y END)*scale+pad_y, 6) AS y FROM q""",
    "segment_codec_forms": """WITH e AS (SELECT event_id AS id, CAST(event_id % 900 AS DOUBLE) AS x, CAST(event_id % 700 AS DOUBLE) AS y, CAST(100 + event_id % 50 AS DOUBLE) AS n, event_id % 4 AS form FROM events)
      SELECT id, x AS s0, CASE WHEN form = 3 THEN y + n ELSE y END AS s1, CASE WHEN form = 0 THEN x ELSE x + n END AS s2, CASE WHEN form IN (1, 3)
      THEN y ELSE y + n END AS s3 FROM e""",
    "page_result": _page_result(),
    "merged_view": f"""WITH RECURSIVE pg AS (SELECT DISTINCT event_id // 25 AS page FROM events), {members('ocr')}
      SELECT page, coalesce(n, 0) AS texts, coalesce(n, 0) AS listed FROM pg LEFT JOIN (SELECT page, count(DISTINCT root) AS n
      FROM m GROUP BY page) USING (page)""",
    "build_datasets": _datasets(),
    "dataset_categories": f"""WITH {sliced('arrow')} SELECT 0::BIGINT AS id, 'annotation-lines' AS name, 'none' AS supercategory UNION ALL
      SELECT row_number() OVER (ORDER BY label), label, 'annotation-lines' FROM (SELECT DISTINCT label FROM sl)""",
    "job_view": """WITH e AS (SELECT event_id % 500 AS job_id, ts, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2
      THEN 'succeeded' ELSE 'failed' END AS status, event_id % 4 AS rk FROM events)
      SELECT job_id, arg_max(status, ts::VARCHAR || rk) AS status, round((epoch_us(max(ts) FILTER (rk >= 2)) - epoch_us(min(ts) FILTER (rk = 1))) / 1e6, 3) AS seconds FROM e
      GROUP BY job_id""",
    "job_drift": """SELECT user_id AS job_id, bool_or(coalesce(CASE WHEN event_id % 9 = 0 THEN NULL
      ELSE event_id % 5 = 0 END, false)) AS drift, count(*) AS pages FROM events GROUP BY user_id""",
    "readiness": """WITH c AS (SELECT user_id AS service, event_type AS name, min(value) > 1 AS ok FROM events GROUP BY ALL)
      SELECT service, bool_and(coalesce(ok, false)) AS ready, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT coalesce(ok, false)), '') AS failing FROM c
      GROUP BY service""",
    "readable_texts": "SELECT event_id AS id FROM events WHERE event_id % 6 IN (1, 3) AND CAST(event_id % 100 AS DOUBLE) / 100 >= 0.3::DOUBLE",
    "clean_metrics": """SELECT event_id AS id, 'val loss_' AS name, value AS number FROM events UNION ALL
      SELECT event_id, 'n', CAST(event_id AS DOUBLE) FROM events""",
    "draw_commands": f"""(WITH {truth('object')} SELECT id, 'object' AS kind, 'box' AS shape, label AS caption FROM tru) UNION ALL (WITH {truth('ocr')} SELECT id, 'ocr' AS kind, 'box' AS shape, left(label, 40) AS caption FROM tru)
      UNION ALL (WITH {truth('arrow')} SELECT id, 'arrow', 'line', label FROM tru)""",
    "request_rates": "SELECT CAST(ts AS DATE) AS day, event_type AS path, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL",
    "state_patch": """WITH r AS (SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 2 THEN 100000000 ELSE 0 END AS job_id, CASE WHEN o_orderkey % 10 = 0
      THEN NULL ELSE 'moved' END AS status, o_orderpriority AS reason FROM orders WHERE o_orderkey % 10 < 3)
      SELECT coalesce(o_orderkey, r.job_id) AS job_id, coalesce(r.status, o_orderstatus) AS status, o_orderpriority AS note, reason FROM orders FULL
      JOIN r ON o_orderkey = r.job_id""",
    "page_names": """WITH p AS (SELECT DISTINCT l_orderkey AS file, l_linenumber - 1 AS page FROM lineitem) SELECT file, page, 'F' || file || CASE
      WHEN count(*) OVER (PARTITION BY file) = 1 THEN '' ELSE '_P' || (page + 1) END AS image_id FROM p""",
    "stored_files": """WITH d AS (SELECT * FROM pages WHERE page_id % 4 <> 0) SELECT 'images/' || page_id || CASE page_id % 3 WHEN 0 THEN '.png'
      WHEN 1 THEN '.tiff' ELSE '.jpg' END AS path, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM d
      UNION ALL SELECT 'annotations/' || page_id || '.json', 2 FROM d""",
    "layout_pairs": f"WITH {LAYOUT}, {LAYOUT_PAIRS} SELECT *, o0-48 AS s0, o1-48 AS s1, o2+96 AS s2, o3+96 AS s3 FROM pairs",
    "layout_slices": f"WITH {LAYOUT}, {truth('object')}, {LAYOUT_SLICES} SELECT page, id, tile_id, item_idx, g0, g1, g2, g3, label FROM sl",
    "layout_arrows": f"""WITH {LAYOUT}, {truth('arrow')},
      p AS (SELECT tru.page, id, tile_id, tx, ty, x1, y1, x2-x1 AS dx, y2-y1 AS dy, greatest(0, least((tx-x1)/(x2-x1), (tx+tw-x1)/(x2-x1)), CASE WHEN y1 = y2 THEN 0
          ELSE least((ty-y1)/(y2-y1), (ty+th-y1)/(y2-y1)) END) AS t0,
        least(1, greatest((tx-x1)/(x2-x1), (tx+tw-x1)/(x2-x1)), CASE WHEN y1 = y2 THEN 1 ELSE greatest((ty-y1)/(y2-y1), (ty+th-y1)/(y2-y1)) END) AS t1
        FROM tru JOIN tiles ON tru.page = tiles.page WHERE y1 <> y2 OR (y1 >= ty AND y1 <= ty + th)),
      q AS (SELECT page, id, tile_id, x1+t0*dx-tx AS g0, y1+t0*dy-ty AS g1, x1+t1*dx-tx AS g2, y1+t1*dy-ty AS g3 FROM p WHERE t0 <= t1)
      SELECT page, id, tile_id, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2, round(g3, 6) AS g3 FROM q WHERE sqrt((g2-g0)*(g2-g0)+(g3-g1)*(g3-g1)) >= 10""",
    "layout_merge": LAYOUT_MERGE,
    "line_peaks": f"WITH {LINE_PEAKS} SELECT tile, a AS angle, rho, votes FROM pk",
    "line_votes": LINES,
    "merge_by_decisions": MERGE_OBJECTS,
    "page_items": _page_items(),
    "job_champions": """WITH t AS (SELECT event_type AS model, event_id AS version, date_trunc('hour', ts) AS ts, value AS metric FROM events WHERE event_id % 3 = 0),
      o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY model, ts ORDER BY metric DESC, version) = 1),
      b AS (SELECT *, max(metric) OVER (PARTITION BY model ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o),
      c AS (SELECT model, ts, version FROM b WHERE best IS NULL OR metric > best),
      p AS (SELECT event_type AS model, date_trunc('day', ts) AS ts, min(event_id) AS baseline FROM events WHERE user_id % 10 = 0 GROUP BY ALL)
      SELECT e.event_id AS job_id, e.event_type AS model, c.version, p.baseline FROM events e
      ASOF LEFT JOIN c ON e.event_type = c.model AND e.ts >= c.ts ASOF LEFT JOIN p ON e.event_type = p.model AND e.ts >= p.ts""",
    "job_replay": """WITH e AS (SELECT event_id % 700 AS job_id, event_id AS seq, ts, (event_id // 3) % 4 AS k, ['queued', 'running', 'succeeded', 'failed'][(event_id // 3) % 4 + 1] AS status FROM events),
      p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, k, seq) AS i FROM e),
      a AS (SELECT job_id, min(i) AS q FROM p WHERE k = 0 GROUP BY job_id), b AS (SELECT p.job_id, min(i) AS r FROM p JOIN a USING (job_id) WHERE k = 1 AND i > q GROUP BY p.job_id),
      c AS (SELECT p.job_id, min(i) AS x, arg_min(status, i) AS last FROM p JOIN b USING (job_id) WHERE k > 1 AND i > r GROUP BY p.job_id)
      SELECT job_id, seq, status, CASE WHEN i > x THEN last WHEN i > r THEN 'running' WHEN i > q THEN 'queued' END AS was, coalesce(i IN (q, r, x), false) AS accepted
      FROM p LEFT JOIN a USING (job_id) LEFT JOIN b USING (job_id) LEFT JOIN c USING (job_id)""",
}
