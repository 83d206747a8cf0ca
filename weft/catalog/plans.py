"""Registered queries for order/packing plans (W11-W14, W17) and media plans (F27, F29,
F30). The oracles of the order plans replay the sequential rules as recursive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.catalog.metrics import words_sql
from weft.fixtures import conv_samples, fx_media, fx_turns, table
from weft.functions.text import word_count
from weft.ids import positions
from weft.operators.aggregates import modality_length, sample_length
from weft.plans import media as MP
from weft.plans import order as O


def _hash_sql(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"


def _interleave_sql(hashed: str) -> str:
    """Slots by keeping the list of free ones: each dataset, largest first, takes its share of it."""
    return f"""WITH RECURSIVE d AS (SELECT source AS dataset, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents),
sz AS (SELECT dataset, count(*) // 8 * 4 AS per FROM d GROUP BY dataset),
b AS (SELECT dataset, idx, per, idx // per AS rank FROM d JOIN sz USING (dataset) WHERE per > 0 AND idx < per * 2),
p AS (SELECT *, row_number() OVER (PARTITION BY dataset, rank ORDER BY {hashed}, idx) AS j FROM b),
o AS (SELECT dataset, per, row_number() OVER (ORDER BY per DESC, dataset) AS k FROM sz WHERE per > 0),
r AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS dataset, []::BIGINT[] AS took, range(0, (SELECT sum(per) FROM o)::BIGINT) AS free
  UNION ALL SELECT x.k, x.dataset, x.took, list_filter(x.free, lambda s: NOT list_contains(x.took, s)) FROM
    (SELECT o.k, o.dataset, r.free, list_transform(range(0, o.per), lambda j: r.free[j * len(r.free) // o.per + 1]) AS took FROM r JOIN o ON o.k = r.k + 1) x)
SELECT p.dataset, p.idx, p.rank, r.took[p.j] AS slot FROM p JOIN r USING (dataset)"""


@query("w11_interleave_plan", _interleave_sql(_hash_sql(42, "dataset || '|' || idx::VARCHAR")))
def w11(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id")
    d = positions(d, ["doc_id"], partition=["dataset"], name="idx")
    return O.interleave_plan(d, "dataset", "idx", world=2, batch=4, accum=1, sp=1, seed=42)


@query("w12_interleave_batch_shuffle", _interleave_sql(_hash_sql(42, "dataset || '|' || rank::VARCHAR || '|' || (idx % per // 4)::VARCHAR")))
def w12(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id")
    d = positions(d, ["doc_id"], partition=["dataset"], name="idx")
    return O.interleave_plan(d, "dataset", "idx", world=2, batch=4, accum=1, sp=1, seed=42, shuffle="batch")


# lengths of conversations as rows (kind, conv_id, length), and their even chunks of two by replay
EVEN_SQL = f"""w AS (SELECT conv_id, sum({words_sql('value')}) AS w FROM fx_turns GROUP BY conv_id),
g AS ({{rows}}),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_hash_sql(42, 'conv_id::VARCHAR')}, conv_id) - 1 AS p FROM g),
o AS (SELECT *, p // 8 AS mb, row_number() OVER (PARTITION BY kind, p // 8 ORDER BY length DESC, p) - 1 AS i, count(*) OVER (PARTITION BY kind, p // 8) AS n FROM p),
r AS (SELECT kind, mb, i, n, conv_id, 0::BIGINT AS chunk, length::BIGINT AS s0, 0::BIGINT AS s1, 1::BIGINT AS c0, 0::BIGINT AS c1 FROM o WHERE i = 0
  UNION ALL SELECT kind, mb, i, n, conv_id, chunk, s0 + CASE chunk WHEN 0 THEN length ELSE 0 END, s1 + CASE chunk WHEN 1 THEN length ELSE 0 END,
      c0 + CASE chunk WHEN 0 THEN 1 ELSE 0 END, c1 + chunk FROM
    (SELECT o.*, r.s0, r.s1, r.c0, r.c1, CASE WHEN o.n % 2 <> 0 THEN o.i % 2 WHEN r.c0 = o.n // 2 THEN 1 WHEN r.c1 = o.n // 2 THEN 0
       WHEN r.s0 <= r.s1 THEN 0 ELSE 1 END AS chunk FROM r JOIN o ON o.kind = r.kind AND o.mb = r.mb AND o.i = r.i + 1) x),
e AS (SELECT kind, conv_id, mb AS megabatch, chunk, row_number() OVER (PARTITION BY kind, mb, chunk ORDER BY i) - 1 AS pos FROM r)"""


@query(
    "w13_length_grouped",
    "WITH RECURSIVE "
    + EVEN_SQL.format(rows="SELECT 'all' AS kind, conv_id, w + CASE WHEN n_img > 0 THEN 128 ELSE 0 END AS length FROM w JOIN fx_convimg USING (conv_id)")
    + " SELECT conv_id, megabatch, chunk, pos FROM e",
)
def w13(spark, sf):
    s = sample_length(conv_samples(spark, sf)).select("conv_id", F.col("length").cast("bigint").alias("length"))
    return O.length_grouped(s, "conv_id", "length", batch=4, world=2)


def _modality_sql(where: str) -> str:
    rows = f"SELECT CASE WHEN conv_id % 3 <> 0 AND n_img > 0 THEN 'mm' ELSE 'lang' END AS kind, conv_id, w AS length FROM w JOIN fx_convimg USING (conv_id) WHERE {where}"
    return (
        "WITH RECURSIVE "
        + EVEN_SQL.format(rows=rows)
        + f""", l AS (SELECT kind, max(megabatch) AS last, count(*) OVER () AS kinds FROM e GROUP BY kind),
x AS (SELECT e.*, kinds = 2 AND megabatch = last AS extra FROM e JOIN l USING (kind)),
f AS (SELECT kind, megabatch, row_number() OVER (ORDER BY {_hash_sql(43, "kind || '|' || megabatch::VARCHAR")}, kind, megabatch) - 1 AS megabatch_order
  FROM (SELECT DISTINCT kind, megabatch FROM x WHERE NOT extra))
SELECT conv_id, kind AS modality, megabatch, chunk, pos, megabatch_order, extra FROM x JOIN f USING (kind, megabatch) WHERE NOT extra
UNION ALL SELECT conv_id, kind, -1, -1, row_number() OVER (ORDER BY conv_id) - 1, (SELECT count(*) FROM f), extra FROM x WHERE extra"""
    )


def _modality_grouped(spark, sf, where):
    s = conv_samples(spark, sf).where(where)
    s = s.withColumn("images", F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("images")))
    s = modality_length(s).select("conv_id", F.col("modality_length").cast("bigint").alias("length"))
    return O.modality_grouped(s, "conv_id", "length", batch=4, world=2)


@query("w14_modality_grouped", _modality_sql("true"))
def w14(spark, sf):
    return _modality_grouped(spark, sf, F.lit(True))


@query("w14_one_modality", _modality_sql("conv_id % 3 = 0"))
def w14_one(spark, sf):
    return _modality_grouped(spark, sf, F.col("conv_id") % 3 == 0)


@query(
    "w17_pack_greedy",
    f"""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS sample, conv_id // 8 AS batch, {words_sql('value')} AS n_tokens,
   len(string_split(value, '<image>')) - 1 AS n_images FROM fx_turns),
l AS (SELECT sample, batch, n_tokens + n_images * 15 AS n, n_images AS im FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, sample) AS i FROM l WHERE n <= 512),
r AS (SELECT sample, batch, i, 0::BIGINT AS pack, 0::BIGINT AS "offset", n, n AS len, im, 0::BIGINT AS longest FROM o WHERE i = 1
  UNION ALL SELECT sample, batch, i, CASE WHEN fits THEN pack ELSE pack + 1 END, CASE WHEN fits THEN len ELSE 0 END, n, CASE WHEN fits THEN len + n ELSE n END,
      CASE WHEN fits THEN images + im ELSE im END, CASE WHEN fits THEN longest ELSE greatest(longest, len) END FROM
    (SELECT o.*, r.pack, r.len, r.im AS images, r.longest,
       r.len + o.n <= 512 AND (r.im = 0 OR (r.im + o.im <= 4 AND r.len + o.n <= r.longest)) AS fits
     FROM r JOIN o ON o.batch = r.batch AND o.i = r.i + 1) x)
SELECT sample, batch, pack, "offset", n AS seqlen FROM r UNION ALL SELECT sample, batch, -1, 0, n FROM l WHERE n > 512""",
)
def w17(spark, sf):
    t = fx_turns(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample"),
        F.floor(F.col("conv_id") / 8).alias("batch"),  # the turns of eight conversations are collated
        word_count(F.col("value")).cast("bigint").alias("n_tokens"),
        (F.size(F.split("value", "<image>", -1)) - 1).cast("bigint").alias("n_images"),
    )
    return O.pack_greedy(t, "sample", "batch", "n_tokens", "n_images", max_len=512, max_images=4, tokens_per_image=16)


def _pack_media_sql(sp: int, multiple: int, max_len: int) -> str:
    """Samples one by one, with the state of the pack that is open; then dummies by pack."""

    def paid(im: str, length: str) -> str:
        return f"CASE WHEN {im} < {sp} AND {length} < {max_len} THEN least({sp} - {im}, CAST(ceil(({max_len} - {length}) / 18.0) AS BIGINT)) ELSE 0 END"

    return f"""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS sample, conv_id // 8 AS batch, {words_sql('value')} AS n_tokens,
   len(string_split(value, '<image>')) - 1 + (conv_id + turn) % 3 AS im FROM fx_turns),
l AS (SELECT *, n_tokens + im * 15 AS raw, CAST(ceil((n_tokens + im * 15) / {multiple}.0) AS BIGINT) * {multiple} AS n, max(im) OVER (PARTITION BY batch) AS most FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY raw DESC, sample) AS i FROM l WHERE n <= {max_len}),
r AS (SELECT sample, batch, i, 0::BIGINT AS turn, 0::BIGINT AS "offset", n, n AS len, im, im AS own, 0::BIGINT AS longest FROM o WHERE i = 1
  UNION ALL SELECT sample, batch, i, turn + (NOT fits)::BIGINT, CASE WHEN fits THEN len ELSE 0 END, n, CASE WHEN fits THEN len + n ELSE n END,
      CASE WHEN fits THEN im + own ELSE own END, own, CASE WHEN fits OR im + paid < {sp} THEN longest ELSE greatest(longest, len + paid * 18) END FROM
    (SELECT o.sample, o.batch, o.i, o.n, o.im AS own, r.turn, r.len, r.im, r.longest, {paid('r.im', 'r.len')} AS paid,
       r.len + o.n <= {max_len} AND (r.im < {sp} OR (r.im + o.im <= o.most AND r.len + o.n <= r.longest)) AS fits
     FROM r JOIN o ON o.batch = r.batch AND o.i = r.i + 1) x),
p AS (SELECT batch, turn, sum(n)::BIGINT AS len, sum(own)::BIGINT AS im FROM r GROUP BY batch, turn),
q AS (SELECT *, {paid('im', 'len')} AS paid FROM p),
k AS (SELECT *, im + paid >= {sp} AS kept, (sum((im + paid >= {sp})::BIGINT) OVER (PARTITION BY batch ORDER BY turn) - 1)::BIGINT AS pack FROM q)
SELECT batch, CASE WHEN kept THEN 'sample' ELSE 'dropped' END AS kind, CASE WHEN kept THEN pack ELSE -1 END AS pack, sample, "offset", n AS seqlen, own AS images
FROM r JOIN k USING (batch, turn)
UNION ALL SELECT batch, 'dummy', pack, NULL, len + d * 18, 18, 1 FROM k, range(0, paid) x(d) WHERE kept
UNION ALL SELECT batch, 'too_long', -1, sample, 0, n, im FROM l WHERE n > {max_len}"""


def _media_turns(spark, sf):
    return fx_turns(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample"),
        F.floor(F.col("conv_id") / 8).alias("batch"),  # the turns of eight conversations are collated
        word_count(F.col("value")).cast("bigint").alias("n_tokens"),
        (F.size(F.split("value", "<image>", -1)) - 1 + (F.col("conv_id") + F.col("turn")) % 3).cast("bigint").alias("n_images"),
    )


@query("w17_pack_media", _pack_media_sql(2, 2, 160))
def w17_media(spark, sf):
    return O.pack_media(_media_turns(spark, sf), "sample", "batch", "n_tokens", "n_images", 160, tokens_per_image=16, sp=2, ring="ring_varlen")


@query("w17_pack_media_zigzag", _pack_media_sql(4, 8, 256))
def w17_zigzag(spark, sf):
    return O.pack_media(_media_turns(spark, sf), "sample", "batch", "n_tokens", "n_images", 256, tokens_per_image=16, sp=4, ring="zigzag_ring_varlen")


def _ratios_sql(lo: int = 1, hi: int = 12) -> str:
    rows = ", ".join(f"({i}, {j}, {k})" for k, (i, j) in enumerate(MP.target_ratios(lo, hi)))
    return f"(VALUES {rows}) r(i, j, ord)"


@query(
    "f27_tile_plan",
    f"""WITH m AS (SELECT media_id, width::DOUBLE / height AS a, (width * height)::DOUBLE AS area FROM fx_media),
x AS (SELECT media_id, area, ord, i, j, abs(a - i::DOUBLE / j) AS d FROM m, {_ratios_sql()}),
mn AS (SELECT media_id, min(d) AS md FROM x GROUP BY media_id),
c AS (SELECT x.* FROM x JOIN mn USING (media_id) WHERE d = md),
f AS (SELECT media_id, min(ord) AS first_ord FROM c GROUP BY media_id),
w AS (SELECT c.media_id, f.first_ord, max(CASE WHEN c.ord > f.first_ord AND c.area > 0.5 * 384 * 384 * c.i * c.j THEN c.ord END) AS win
  FROM c JOIN f USING (media_id) GROUP BY c.media_id, f.first_ord)
SELECT w.media_id, r.i AS cols, r.j AS "rows", r.i * r.j AS blocks, r.i * r.j + CASE WHEN r.i * r.j <> 1 THEN 1 ELSE 0 END AS tiles
FROM w JOIN {_ratios_sql()} ON r.ord = coalesce(w.win, w.first_ord)""",
)
def f27(spark, sf):
    m = fx_media(spark, sf)
    p = m.select("media_id", MP.tile_plan("width", "height").alias("p"))
    return p.select("media_id", F.col("p.cols").cast("bigint").alias("cols"), F.col("p.rows").cast("bigint").alias("rows"),
                    F.col("p.blocks").cast("bigint").alias("blocks"), F.col("p.tiles").cast("bigint").alias("tiles"))


@query(
    "f29_square_pad",
    "SELECT media_id, greatest(width, height) AS side, (greatest(width, height) - width) // 2 AS \"left\", (greatest(width, height) - height) // 2 AS top FROM fx_media",
)
def f29(spark, sf):
    m = fx_media(spark, sf)
    return m.select("media_id", MP.square_pad("width", "height").alias("p")).select("media_id", "p.side", F.col("p.left").cast("bigint").alias("left"), F.col("p.top").cast("bigint").alias("top"))


@query(
    "f29_short_side_resize",
    """SELECT media_id, CASE WHEN least(width, height) <= 336 THEN width WHEN height < width THEN floor(336 * width::DOUBLE / height) ELSE 336 END::BIGINT AS w,
  CASE WHEN least(width, height) <= 336 THEN height WHEN height < width THEN 336 ELSE floor(336 * height::DOUBLE / width) END::BIGINT AS h FROM fx_media""",
)
def f29_resize(spark, sf):
    m = fx_media(spark, sf)
    return m.select("media_id", MP.short_side_resize("width", "height").alias("p")).select("media_id", F.col("p.width").alias("w"), F.col("p.height").alias("h"))


@query(
    "f30_frame_indices",
    """SELECT media_id,
  array_to_string(list_transform(range(8), lambda i: (CASE WHEN i = 7 THEN frame_count - 1 ELSE trunc(i * ((frame_count - 1) / 7)) END)::BIGINT::VARCHAR), ',') AS frames,
  array_to_string(list_transform(range(8), lambda i: (CASE WHEN i = 7 THEN frame_count - 1 ELSE round_even(i * ((frame_count - 1) / 7), 0) END)::BIGINT::VARCHAR), ',') AS rounded
FROM fx_media""",
)
def f30(spark, sf):
    m = fx_media(spark, sf)
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("media_id", j(MP.frame_indices("frame_count", 8)).alias("frames"), j(MP.frame_indices("frame_count", 8, rounded=True)).alias("rounded"))


@query(
    "f30_frames_by_rate",
    """WITH m AS (SELECT media_id, fps, frame_count AS fc, frame_count::DOUBLE / fps AS d FROM fx_media),
n AS (SELECT *, CASE WHEN fc = 0 THEN 0 WHEN d >= 4 THEN CASE WHEN fc <= 1 THEN 0 WHEN fc < 8 THEN fc ELSE 8 END
   WHEN floor(d * 2) = 0 THEN 0 ELSE greatest(floor(d * 2), 2) END::BIGINT AS n FROM m),
f AS (SELECT DISTINCT media_id, CASE WHEN i = n - 1 THEN fc - 1 ELSE trunc(i * ((fc - 1) / (n - 1))) END::BIGINT AS frame FROM n, range(0, n) r(i))
SELECT media_id, coalesce(string_agg(frame::VARCHAR, ',' ORDER BY frame), '') AS frames FROM m LEFT JOIN f USING (media_id) GROUP BY media_id""",
)
def f30_rate(spark, sf):
    m = fx_media(spark, sf)
    frames = MP.frames_by_rate("frame_count", "fps", 8, 2.0)
    return m.select("media_id", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


@query(
    "f28_multiscale_tile_plan",
    f"""WITH m AS (SELECT media_id, width::DOUBLE / height AS a, (width * height)::DOUBLE AS area FROM fx_media),
x AS (SELECT media_id, area, ord, i, j, abs(a - i::DOUBLE / j) AS d FROM m, {_ratios_sql(9, 12)}),
mn AS (SELECT media_id, min(d) AS md FROM x GROUP BY media_id),
c AS (SELECT x.* FROM x JOIN mn USING (media_id) WHERE d = md),
f AS (SELECT media_id, min(ord) AS first_ord FROM c GROUP BY media_id),
w AS (SELECT c.media_id, f.first_ord, max(CASE WHEN c.ord > f.first_ord AND c.area > 0.5 * 384 * 384 * c.i * c.j THEN c.ord END) AS win
  FROM c JOIN f USING (media_id) GROUP BY c.media_id, f.first_ord)
SELECT w.media_id, r.j AS "rows", r.i AS cols, 5 AS fixed, 5 + r.i * r.j AS tiles
FROM w JOIN {_ratios_sql(9, 12)} ON r.ord = coalesce(w.win, w.first_ord)""",
)
def f28(spark, sf):
    m = fx_media(spark, sf)
    p = m.select("media_id", MP.multiscale_tile_plan("width", "height").alias("p"))
    return p.select("media_id", *[F.col(f"p.{c}").cast("bigint").alias(c) for c in ("rows", "cols", "fixed", "tiles")])
