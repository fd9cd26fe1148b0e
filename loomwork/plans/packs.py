"""Queries about packing: blocks, windows, padding, best-fit rows, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import hash60, pretokens
from loomwork.operators import bpe, chunking, encode, packing, render
from loomwork.operators.running import with_ordinal
from loomwork.plans import chats, tokens
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import h60, pieces
from loomwork.session import spread, stored

_STREAM_SQL = f"""
    WITH d AS (SELECT doc_id, {pieces('text')} AS p FROM documents),
    o AS (SELECT doc_id, p, coalesce(sum(len(p)) OVER (ORDER BY doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
    s AS (SELECT start + unnest(range(0, len(p))) AS i, unnest(p) AS token FROM o)
"""


def _pieces(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", pretokens(F.col("text")).alias("tokens"))


def _blocks_sql(size: int) -> str:
    return _STREAM_SQL + f"""
    SELECT (i // {size})::BIGINT AS block_id, count(*)::BIGINT AS n,
           md5(string_agg(token, '|' ORDER BY i)) AS tokens_md5
    FROM s GROUP BY 1 HAVING count(*) = {size}
    """


def block_digest(blocks):
    return blocks.select(
        "block_id",
        F.size("tokens").cast("bigint").alias("n"),
        F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
    )


@query("chunk_fixed", _blocks_sql(512))
def chunk_fixed(spark, sf_dir):
    return block_digest(chunking.fixed_blocks(_pieces(spark, sf_dir), "doc_id", 512))


@query("block_fixed", _blocks_sql(129))
def block_fixed(spark, sf_dir):
    return block_digest(chunking.fixed_blocks(_pieces(spark, sf_dir), "doc_id", 128 + 1))


@query(
    "random_windows",
    _STREAM_SQL
    + f"""
    , n AS (SELECT count(*) AS n FROM s),
    w AS (SELECT doc_id AS window_id, {h60("'window'", 'doc_id')} % (n - 64 - 1) AS start FROM documents, n)
    SELECT window_id, md5(string_agg(token, '|' ORDER BY i) FILTER (i < start + 64)) AS x_md5,
           md5(string_agg(token, '|' ORDER BY i) FILTER (i > start)) AS y_md5
    FROM w JOIN s ON i BETWEEN start AND start + 64 GROUP BY window_id
    """,
)
def random_windows(spark, sf_dir):
    docs = _pieces(spark, sf_dir)
    total = docs.agg(F.sum(F.size("tokens")).cast("bigint").alias("n")).scalar()
    windows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("window_id"),
        (hash60(F.lit("window"), "doc_id") % (total - 64 - 1)).alias("start"),
    )
    blocks = chunking.fixed_blocks(docs, "doc_id", 1024, keep_tail=True)
    return chunking.random_windows(blocks, 1024, windows, 64).select(
        "window_id",
        F.md5(F.array_join("x", "|")).alias("x_md5"),
        F.md5(F.array_join("y", "|")).alias("y_md5"),
    )


@query(
    "pad_group",
    chats._FOLD_SQL
    + chats._MARKER_SQL
    + """
    , b AS (SELECT conv_id, tokens, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch FROM conv),
    m AS (SELECT *, max(len(tokens)) OVER (PARTITION BY batch) AS longest FROM b)
    SELECT conv_id, batch::BIGINT AS batch, len(tokens)::BIGINT AS n_real, longest::BIGINT AS n_padded,
           md5(array_to_string(list_concat(tokens, list_transform(range(0, longest - len(tokens)), lambda x: 1200000::BIGINT)), ',')) AS tokens_md5
    FROM m
    """,
)
def pad_group(spark, sf_dir):
    rendered = stored(
        render.render(chats.turns_of(spark, sf_dir), chats.MARKERS).select("conv_id", "tokens"), "rendered"
    )
    ids = with_ordinal(rendered.select("conv_id"), "conv_id").select(
        "conv_id", F.floor(F.col("ordinal") / 8).alias("batch")
    )
    padded = chunking.pad_to_longest(rendered.join(ids, "conv_id"), "batch", chats.MARKER_IDS["<|bos|>"])
    return padded.select(
        "conv_id",
        "batch",
        F.col("n_real").cast("bigint").alias("n_real"),
        F.size("tokens").cast("bigint").alias("n_padded"),
        F.md5(F.array_join("tokens", ",")).alias("tokens_md5"),
    )


CAPACITY = 2048 + 1


_TEXT_PIECES = pieces("text")
# Stands for the number of reading ranks.
N_GROUPS = 16
# Chats of at most 2048 ids and one more, several to a row.
CHAT_CAPACITY = 4 * 2048 + 1


def _plan_sql(lengths: str, capacity: int, buffer: int, crop: bool, epochs: int = 1) -> str:
    """CTEs up to ``placed``: the packing rule step by step, the waiting sequences as a list.

    ``lengths`` gives (doc_id, n); they are read ``epochs`` times over. A waiting entry is (l, a): length and negated arrival,
    so that the greatest is the longest and, of equals, the one that came first.
    """
    shortest = "list_sort(list_transform(buf, lambda x: {'l': x.l, 'a': -x.a}))[1]"
    pick = f"coalesce(fit, {{'l': {shortest}.l, 'a': -{shortest}.a}})" if crop else "fit"
    return f"""
    sized AS (SELECT doc_id, n::BIGINT AS n, ({h60('doc_id')} % {N_GROUPS})::INT AS pack_group FROM ({lengths}) WHERE n > 0),
    arrived AS (SELECT *, row_number() OVER (PARTITION BY pack_group ORDER BY doc_id) AS arrival FROM sized),
    once AS (SELECT pack_group, count(*) AS size, list({{'l': n, 'a': -arrival}} ORDER BY doc_id) AS items FROM arrived GROUP BY pack_group),
    src AS (
      SELECT pack_group, size,
        flatten(list_transform(range(0, {epochs}), lambda e: list_transform(items, lambda x: {{'l': x.l, 'a': x.a - e * size}}))) AS items
      FROM once),
    walk AS (
      SELECT pack_group, 0::BIGINT AS row_in_group, 0::BIGINT AS filled, 0::BIGINT AS pos, items[1:{buffer}] AS buf,
             {buffer}::BIGINT AS seen, NULL::BIGINT AS arrival, NULL::BIGINT AS at_row, NULL::BIGINT AS at_pos,
             NULL::BIGINT AS start_at, NULL::BIGINT AS take
      FROM src
      UNION ALL
      SELECT pack_group,
             CASE WHEN pick IS NULL OR filled + least(pick.l, {capacity} - filled) = {capacity} THEN row_in_group + 1 ELSE row_in_group END,
             CASE WHEN pick IS NULL OR filled + least(pick.l, {capacity} - filled) = {capacity} THEN 0 ELSE filled + least(pick.l, {capacity} - filled) END,
             CASE WHEN pick IS NULL OR filled + least(pick.l, {capacity} - filled) = {capacity} THEN 0 ELSE pos + 1 END,
             CASE WHEN pick IS NULL THEN buf
                  ELSE list_concat(list_filter(buf, lambda x: x.a <> pick.a), items[(seen + 1):(seen + 1)]) END,
             CASE WHEN pick IS NULL THEN seen ELSE seen + 1 END,
             -pick.a, CASE WHEN pick IS NOT NULL THEN row_in_group END, pos, filled, least(pick.l, {capacity} - filled)
      FROM (SELECT *, {pick} AS pick
            FROM (SELECT walk.*, items, list_max(list_filter(buf, lambda x: x.l <= {capacity} - filled)) AS fit
                  FROM walk JOIN src USING (pack_group) WHERE len(buf) > 0))),
    placed AS (
      SELECT w.pack_group, at_row AS row_in_group, at_pos AS pos, doc_id, start_at, take, n AS n_tokens{", ((w.arrival - 1) // size)::INT AS epoch" * (epochs > 1)}
      FROM walk w JOIN src USING (pack_group)
      JOIN arrived a ON a.pack_group = w.pack_group AND a.arrival = (w.arrival - 1) % size + 1)
    """


_CHAT_LENGTHS = "SELECT conv_id AS doc_id, least(len(tokens), 2048) AS n FROM conv"


def _chat_plan_sql() -> str:
    head = (chats._FOLD_SQL + chats._MARKER_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    return head + ", " + _plan_sql(_CHAT_LENGTHS, CHAT_CAPACITY, 20, crop=False)


def _encoded(spark, sf_dir, merges: int = 24):
    """Documents as byte-pair tokens with their pack group, stored once.

    The table is read by the planner (lengths) and by the row filler (tokens).
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    vocabulary = bpe.train(docs, bpe.BYTE_IDS + merges + len(bpe.SPECIAL_TOKENS))
    ids = encode.tokenize(docs, vocabulary, prepend=vocabulary.bos()).drop("text")
    return packing.with_pack_group(stored(ids, "tokens"), n_groups=N_GROUPS), vocabulary


@query("pack_crop")
def pack_crop(spark, sf_dir):
    encoded, _ = _encoded(spark, sf_dir)
    placements = stored(packing.plan(encoded, CAPACITY, crop=True, buffer_size=1000))
    whole = packing.quality(placements, CAPACITY).select(F.lit("(all)").alias("lang"), "*")
    by_lang = placements.join(encoded.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.count_distinct("pack_group", "row_in_group").alias("n_rows"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("take").alias("placed_tokens"),
        (1 - F.sum("take") / F.sum("n_tokens")).alias("cropped_share"),
    )
    return whole.unionByName(by_lang, allowMissingColumns=True)


_CROP_ROWS_SQL = (
    "WITH RECURSIVE "
    + ", ".join(tokens.encoding_ctes(24))
    + f"""
    , toks AS (SELECT doc_id, list_transform(string_split('{256 + 24}' || coalesce(',' || ids, ''), ','), lambda x: x::INT) AS tokens
               FROM documents LEFT JOIN j USING (doc_id)),
    {_plan_sql("SELECT doc_id, len(tokens) AS n FROM toks", CAPACITY, 1000, crop=True)},
    filled AS (SELECT pack_group, row_in_group, count(*) AS n_docs, sum(take) AS content_len, flatten(list(tokens[1:take] ORDER BY pos)) AS t
               FROM placed JOIN toks USING (doc_id) GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY pack_group, row_in_group) - 1 AS row_id, n_docs, content_len::INT AS content_len,
           content_len = {CAPACITY} AS is_full, md5(array_to_string(t[1:{CAPACITY - 1}], ',')) AS inputs_md5,
           md5(array_to_string(t[2:{CAPACITY}], ',')) AS targets_md5
    FROM filled
    """
)


@query("pack_crop_rows", _CROP_ROWS_SQL)
def pack_crop_rows(spark, sf_dir):
    encoded, _ = _encoded(spark, sf_dir)
    placements = stored(packing.plan(encoded, CAPACITY, crop=True, buffer_size=1000))
    rows = packing.fill_rows(encoded, placements, {"tokens": None}, CAPACITY)
    numbered = packing.number_rows(placements).select("pack_group", "row_in_group", "n_docs", "row_id")
    inputs, targets = chunking.shift(F.col("tokens"), CAPACITY - 1)
    return rows.join(numbered, ["pack_group", "row_in_group"]).select(
        "row_id",
        "n_docs",
        "content_len",
        (F.col("content_len") == CAPACITY).alias("is_full"),
        F.md5(F.array_join(inputs, ",")).alias("inputs_md5"),
        F.md5(F.array_join(targets, ",")).alias("targets_md5"),
    )


@query(
    "pack_crop_coverage",
    f"""
    SELECT doc_id, (len({pieces('text')}) + 1)::BIGINT AS n_tokens, 1::BIGINT AS n_placements,
           true AS row_within_capacity
    FROM documents
    """,
)
def pack_crop_coverage(spark, sf_dir):
    docs = _pieces(spark, sf_dir).select("doc_id", (F.size("tokens") + 1).alias("n_tokens"))
    grouped = packing.with_pack_group(docs, n_groups=N_GROUPS)
    placements = stored(packing.plan(grouped, CAPACITY, crop=True, buffer_size=1000))
    fits = placements.groupBy("doc_id", "n_tokens").agg(
        F.count(F.lit(1)).alias("n_placements"),
        F.bool_and((F.col("start_at") + F.col("take") <= CAPACITY) & (F.col("take") >= 1)).alias(
            "row_within_capacity"
        ),
    )
    return fits


@query(
    "pack_plan_crop",
    f"WITH RECURSIVE {_plan_sql(f'SELECT doc_id, len({_TEXT_PIECES}) + 1 AS n FROM documents', CAPACITY, 64, crop=True)} SELECT * FROM placed",
)
def pack_plan_crop(spark, sf_dir):
    docs = _pieces(spark, sf_dir).select("doc_id", (F.size("tokens") + 1).alias("n_tokens"))
    grouped = packing.with_pack_group(docs, N_GROUPS)
    return packing.plan(grouped, CAPACITY, crop=True, buffer_size=64)


def _padded(spark, sf_dir):
    turns = chats.turns_of(spark, sf_dir)
    rendered = render.render(turns, chats.MARKERS).withColumnRenamed("conv_id", "doc_id")
    sized = stored(rendered.withColumn("n_tokens", F.size("tokens")), "rendered")
    grouped = packing.with_pack_group(sized, N_GROUPS)
    return grouped, stored(packing.plan(grouped, CHAT_CAPACITY, crop=False, buffer_size=20))


_PAD_SQL = (
    _chat_plan_sql()
    + f"""
    , filled AS (
      SELECT pack_group, row_in_group, sum(take) AS content_len, flatten(list(tokens[1:take] ORDER BY pos)) AS t,
             flatten(list(mask[1:take] ORDER BY pos)) AS m
      FROM placed JOIN conv ON conv_id = doc_id GROUP BY ALL),
    padded AS (
      SELECT pack_group, row_in_group, content_len, list_concat(t, list_transform(range(0, ({CHAT_CAPACITY} - content_len)::BIGINT), lambda x: 1200000::BIGINT)) AS t,
             list_concat(m, list_transform(range(0, ({CHAT_CAPACITY} - content_len)::BIGINT), lambda x: 0)) AS m
      FROM filled)
    SELECT pack_group, row_in_group, content_len::INT AS content_len, md5(array_to_string(t[1:{CHAT_CAPACITY - 1}], ',')) AS inputs_md5,
           md5(array_to_string(list_transform(range(2, {CHAT_CAPACITY} + 1), lambda i:
             CASE WHEN m[i] = 0 OR (content_len < {CHAT_CAPACITY} AND i > content_len) THEN -1 ELSE t[i] END), ',')) AS targets_md5
    FROM padded
    """
)


@query("pack_pad", _PAD_SQL)
def pack_pad(spark, sf_dir):
    rendered, placements = _padded(spark, sf_dir)
    bos = chats.MARKER_IDS["<|bos|>"]
    rows = packing.fill_rows(rendered, placements, {"tokens": bos, "mask": 0}, CHAT_CAPACITY)
    out = packing.masked_targets(rows, CHAT_CAPACITY)
    return out.select(
        "pack_group", "row_in_group", "content_len",
        F.md5(F.array_join("inputs", ",")).alias("inputs_md5"), F.md5(F.array_join("targets", ",")).alias("targets_md5"),
    )


@query(
    "pack_pad_quality",
    _chat_plan_sql()
    + f"""
    SELECT count(DISTINCT (pack_group, row_in_group))::BIGINT AS n_rows, count(*)::BIGINT AS n_docs, sum(n_tokens)::BIGINT AS n_tokens,
           sum(take)::BIGINT AS placed_tokens, sum(take) / (count(DISTINCT (pack_group, row_in_group)) * {CHAT_CAPACITY}) AS utilisation,
           1 - sum(take) / sum(n_tokens) AS cropped_share,
           1 - sum(take) / (count(DISTINCT (pack_group, row_in_group)) * {CHAT_CAPACITY}) AS padded_share
    FROM placed
    """,
)
def pack_pad_quality(spark, sf_dir):
    _, placements = _padded(spark, sf_dir)
    return packing.quality(placements, CHAT_CAPACITY)


@query(
    "pack_resume",
    _chat_plan_sql()
    + """
    , rows_ AS (SELECT pack_group, row_in_group, count(*) AS docs, row_number() OVER (ORDER BY pack_group, row_in_group) - 1 AS row_id
                FROM placed GROUP BY pack_group, row_in_group),
    steps AS (SELECT row_id // 4 AS step, count(*)::BIGINT AS n_rows, sum(docs) AS docs FROM rows_ GROUP BY 1),
    walked AS (SELECT step::BIGINT AS step, n_rows, (sum(docs) OVER (ORDER BY step))::BIGINT AS consumed FROM steps),
    total AS (SELECT count(*) AS n FROM conv)
    SELECT step, n_rows, consumed, consumed / n AS progress, consumed >= n AS last_step,
           (SELECT count(*) FROM rows_ WHERE row_id // 4 > 1)::BIGINT AS rows_after_step_1
    FROM walked, total
    """,
)
def pack_resume(spark, sf_dir):
    """Loader state per step, and what each step's resume would still read."""
    chats_, placements = _padded(spark, sf_dir)
    numbered = stored(packing.number_rows(placements), "rows")
    state = packing.steps(numbered, 4, chats_.count())
    after = packing.resume(numbered, 4, 1).agg(F.count(F.lit(1)).alias("rows_after_step_1"))
    return state.withColumn("rows_after_step_1", F.lit(after.scalar()))


_STEP_ROWS = 4
_RESUME_SQL = (
    "WITH RECURSIVE "
    + _plan_sql(f"SELECT doc_id, len({_TEXT_PIECES}) + 1 AS n FROM documents", CAPACITY, 8, crop=True, epochs=2)
    + f"""
    , states AS (
      SELECT pack_group, (row_in_group // {_STEP_ROWS})::INT AS step, list_sort(list_transform(buf, lambda x: {{'a': -x.a, 'l': x.l}})) AS waiting,
             least(seen, len(items)) AS read, size
      FROM walk JOIN src USING (pack_group)
      WHERE pos = 0 AND filled = 0 AND row_in_group % {_STEP_ROWS} = 0 AND len(buf) > 0),
    held AS (
      SELECT s.pack_group, s.step, string_agg(a.doc_id || ':' || (w.a - 1) // size || ':' || w.l, ',' ORDER BY w.a) AS waiting
      FROM (SELECT *, unnest(waiting) AS w FROM states) s JOIN arrived a ON a.pack_group = s.pack_group AND a.arrival = (w.a - 1) % size + 1
      GROUP BY s.pack_group, s.step),
    steps AS (
      SELECT pack_group, (row_in_group // {_STEP_ROWS})::INT AS step,
             md5(string_agg(concat_ws(':', row_in_group, pos, doc_id, epoch, start_at, take), ',' ORDER BY row_in_group, pos)) AS placed_md5
      FROM placed GROUP BY ALL)
    SELECT s.pack_group, s.step, ((read - 1) // size)::INT AS epoch, a.doc_id AS cursor, (read - len(s.waiting))::BIGINT AS consumed,
           h.waiting, t.placed_md5
    FROM states s JOIN arrived a ON a.pack_group = s.pack_group AND a.arrival = (read - 1) % size + 1
    JOIN held h ON h.pack_group = s.pack_group AND h.step = s.step
    JOIN steps t ON t.pack_group = s.pack_group AND t.step = s.step
    """
)


@query("pack_resume_state", _RESUME_SQL)
def pack_resume_state(spark, sf_dir):
    """The loader's state before every step of two epochs, and what the step places: from step 2
    on as planned by a run that went on from a saved state."""
    docs = stored(_pieces(spark, sf_dir).select("doc_id", (F.size("tokens") + 1).alias("n_tokens")), "sizes")
    rows = packing.with_pack_group(docs, N_GROUPS)

    def planned(state=None):
        return stored(packing.plan_steps(rows, CAPACITY, True, 8, _STEP_ROWS, epochs=2, state=state), "steps")

    whole = planned()
    states = packing.saved_states(whole)
    step = F.floor(F.col("row_in_group") / _STEP_ROWS).cast("int")
    runs = [whole.withColumn("from", F.lit(0))]
    # Interrupted before steps 2, 9 and 30, where a group gets that far.
    cuts = [2, 9, 30]
    for cut in cuts:
        runs.append(planned(states.filter(F.col("step") == cut)).withColumn("from", F.lit(cut)))
    all_runs = runs[0]
    for r in runs[1:]:
        all_runs = all_runs.unionByName(r)
    placed = all_runs.filter("row_in_group IS NOT NULL").withColumn("at", step)
    piece = F.concat_ws(":", "row_in_group", "pos", "doc_id", "epoch", "start_at", "take")
    digests = placed.groupBy("pack_group", F.col("at").alias("step"), "from").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_in_group", "pos", piece.alias("p")))), lambda x: x["p"]), ",")).alias("placed_md5")
    )
    # The run that was interrupted last before the step.
    latest = digests.groupBy("pack_group", "step").agg(F.max_by("placed_md5", "from").alias("placed_md5"))
    shown = F.array_join(F.transform("waiting", lambda w: F.concat_ws(":", w["doc_id"], w["epoch"], w["n_tokens"])), ",")
    return states.select("pack_group", "step", "epoch", "cursor", "consumed", shown.alias("waiting")).join(latest, ["pack_group", "step"])
