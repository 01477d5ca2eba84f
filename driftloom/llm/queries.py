"""The registered queries of the text operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import centroids, chat_quotes, collocations, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, pii, quality, repeats, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat_quotes.link_quotes(table(spark, sf_dir, "conversations"))
    return linked.withColumn("content_sha256", F.sha2("content", 256)).drop("content")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP1_SQL = rf"""
    WITH m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
    lines AS (SELECT r, conv_id, turn, unnest(range(len(l))) AS i, unnest(l) AS raw FROM m),
    marked AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^(?:[ 	]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(raw, '^(?:[ 	]*>)+', '') AS line FROM lines),
    edges AS (SELECT *, trim(line, {_WS}) = '' AS blank, NOT (trim(line, {_WS}) = '') AND (i = 0 OR trim(lag(line) OVER w, {_WS}) = '' OR lag(level) OVER w <> level) AS starts FROM marked WINDOW w AS (PARTITION BY r ORDER BY i)),
    numbered AS (SELECT *, sum(starts::INT) OVER (PARTITION BY r ORDER BY i) AS p FROM edges),
    passages AS (SELECT r, conv_id, turn, p, arg_min(level, i) AS level, string_agg(line, chr(10) ORDER BY i) AS passage FROM numbered WHERE p > 0 GROUP BY r, conv_id, turn, p),
    normal AS (SELECT *, lower(trim(regexp_replace(passage, '[ 	-
]+', ' ', 'g'))) AS k FROM passages),
    own AS (SELECT DISTINCT conv_id, turn AS source, k FROM normal WHERE level = 0),
    hits AS (SELECT q.conv_id, q.turn, q.r, q.p, q.level, max(source) AS source FROM normal AS q JOIN own ON q.conv_id = own.conv_id AND q.k = own.k AND source < q.turn WHERE q.level > 0 GROUP BY ALL),
    links AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(source, (level, -source)) AS quoted FROM hits GROUP BY conv_id, turn),
    up AS (SELECT n.conv_id, n.turn, coalesce(n_linked, 0) AS n_linked, quoted, lag(n.turn) OVER (PARTITION BY n.conv_id ORDER BY n.turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations) AS n LEFT JOIN links USING (conv_id, turn)),
    tree AS (SELECT *, coalesce(quoted, before) AS parent FROM up),
    deep AS (WITH RECURSIVE d AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT tree.conv_id, tree.turn, d.thread, d.depth + 1 FROM tree JOIN d ON tree.conv_id = d.conv_id AND tree.parent = d.turn) SELECT * FROM d),
    texts AS (SELECT r, coalesce(string_agg(trim(passage, {_WS}), chr(10) || chr(10) ORDER BY p) FILTER (level = 0), '') AS content, count(*) FILTER (level > 0) AS n_quotes, max(level) AS depth FROM passages GROUP BY r)
    SELECT m.conv_id, m.turn, m.role, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(texts.depth, 0)::INT AS quote_depth, n_linked::BIGINT AS n_linked, parent AS parent_turn,
      CASE WHEN quoted IS NOT NULL THEN 'quote' WHEN before IS NOT NULL THEN 'order' ELSE 'start' END AS reply_by, thread AS thread_turn, deep.depth::BIGINT AS reply_depth, sha256(coalesce(content, '')) AS content_sha256
    FROM m JOIN tree ON m.conv_id = tree.conv_id AND m.turn = tree.turn JOIN deep ON m.conv_id = deep.conv_id AND m.turn = deep.turn LEFT JOIN texts ON m.r = texts.r"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizer()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts], "base_failed", "kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max", hash_all=True)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending")


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), "mix_block", "mix_epoch")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    base = F.filter(spans, lambda x: x["kind"].isin(*pii.BASE))
    of_kind = lambda k: F.filter(spans, lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    more = [F.size(of_kind(k.name)).cast("long").alias(f"n_{k.name}") for k in pii.KINDS if k.name not in pii.BASE]
    scores = F.transform(spans, lambda x: x["score"])
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(spans).alias("spans"), *more, F.size(spans).cast("long").alias("n_spans"), F.array_max(scores).alias("max_score"), scores.alias("scores"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN frequent AS f ON keyed.k = f.k GROUP BY r, doc_id"""


SQL_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def mix_sql(docs: str) -> str:
    """The SQL of a mix of a table or common table expression; the bisection is written out step by step."""
    steps, target = [], f"{mixing.ENTROPY_SHARE} * ln(n)"
    measure = "(SELECT {what} FROM (SELECT sum(pow(p, {x})) AS s, sum(pow(p, {x}) * ln(p)) AS t, max(pow(p, {x}) / tokens) AS m FROM shares) AS z)"
    entropy, repeats = "ln(s) - {x} * t / s", "m / s * (SELECT sum(tokens) FROM shares)"
    for name, what, low_side in (("e", entropy, f">= (SELECT {target} FROM sizes)"), ("r", repeats, f"> {mixing.MAX_REPEATS}")):
        steps.append(f"{name}0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)")
        for i in range(mixing.STEPS):
            x = f"(SELECT (lo + hi) / 2 FROM {name}{i})"
            test = f"{measure.format(what=what.format(x=x), x=x)} {low_side}"
            steps.append(f"{name}{i + 1} AS MATERIALIZED (SELECT CASE WHEN {test} THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {test} THEN hi ELSE (lo + hi) / 2 END AS hi FROM {name}{i})")
    one = measure.format(what=entropy.format(x=1.0), x=1.0)
    last = mixing.STEPS
    return rf"""
    WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, source, md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS o, len({SQL_WORDS.format(text="coalesce(text, '')")}) + 1 AS tokens FROM {docs}),
    sums AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM rows_ GROUP BY source),
    shares AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM sums) AS p FROM sums), sizes AS (SELECT count(*) AS n FROM shares),
    {", ".join(steps)},
    by_entropy AS MATERIALIZED (SELECT CASE WHEN n < 2 OR {one} >= {target} THEN 1.0 ELSE (SELECT lo FROM e{last}) END AS x FROM sizes),
    chosen AS MATERIALIZED (SELECT CASE WHEN (SELECT n FROM sizes) >= 2 AND {measure.format(what=repeats.format(x="x"), x="(SELECT x FROM by_entropy)")} > {mixing.MAX_REPEATS} THEN (SELECT hi FROM r{last}) ELSE x END AS x FROM by_entropy),
    plan AS (SELECT source, w, ceil(docs / {mixing.BLOCK_DOCS})::BIGINT AS blocks, (SELECT sum(tokens) FROM shares) * w / tokens AS repeats
      FROM (SELECT *, pow(p, (SELECT x FROM chosen)) / (SELECT sum(pow(p, (SELECT x FROM chosen))) FROM shares) AS w FROM shares)),
    placed AS (SELECT rows_.*, w, repeats, ('0x' || substr(o, 25, 8))::BIGINT % blocks AS block FROM rows_ JOIN plan ON rows_.source IS NOT DISTINCT FROM plan.source),
    summed AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block) * (repeats - floor(repeats)) AS part,
      coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY o, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed),
    cut AS (SELECT *, max(CASE WHEN before + tokens / 2 < part THEN o END) OVER (PARTITION BY source, block) AS last FROM summed),
    timed AS (SELECT *, floor(repeats)::BIGINT + CASE WHEN o <= last THEN 1 ELSE 0 END AS times FROM cut)
    SELECT doc_id, source, tokens::BIGINT AS mix_tokens, round(w, 6) AS mix_weight, block AS mix_block, unnest(range(1, times + 1))::INT AS mix_epoch, r AS row_ FROM timed"""


def op3_sql() -> str:
    text = "coalesce(text, '')"
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {text} AS t, {SQL_WORDS.format(text=text)} AS w, string_split({text}, chr(10)) AS l FROM documents),
    windows AS (SELECT r, i, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS o(k) GROUP BY r),
    m AS (SELECT d.r, doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl, coalesce(covered.n, 0) AS n_repeat_words,
      length(regexp_replace(t, '[^!]', '', 'g')) AS n_bang, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
      len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ell
      FROM d LEFT JOIN covered ON d.r = covered.r),
    q AS (SELECT *, len(fl) AS n_lines, len(fl) - len(list_distinct(fl)) AS n_dup, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed, coalesce(chars, 0) AS word_chars FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
      NOT (failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols / n_words > 0.1 OR n_bang / n_words > 0.3
        OR (n_upper + n_lower > 0 AND n_upper / (n_upper + n_lower) > 0.6) OR (n_words >= 100 AND n_stop / n_words < 0.01)
        OR (n_words >= 20 AND n_dup / n_lines > 0.5) OR (n_words >= 20 AND n_ell / n_lines > 0.6)) AS kept
    FROM q"""


OP10_SQL = """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("cut")


OP11_SQL = r"""
    WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM texts),
    grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS s(k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, g, count(*) AS c FROM grams GROUP BY ALL),
    total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    often AS MATERIALIZED (SELECT * FROM f WHERE c >= 100),
    cuts AS (SELECT a.lang, a.g, a.c, a.k, unnest(range(1, a.k)) AS cut FROM often AS a WHERE a.k > 1),
    scores AS (SELECT cuts.lang, cuts.g, cuts.c, cuts.k, cut, x.c AS l, y.c AS r, n, ((1000 * cuts.c::HUGEINT * n) // (x.c::HUGEINT * y.c))::BIGINT AS score
      FROM cuts JOIN often AS x ON x.lang = cuts.lang AND x.g = list_slice(cuts.g, 1, cut) JOIN often AS y ON y.lang = cuts.lang AND y.g = list_slice(cuts.g, cut + 1, cuts.k) JOIN total ON total.lang = cuts.lang),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
    inner_ AS (SELECT lang, list_slice(g, i, i + j - 1) AS g, c FROM (SELECT lang, g, c, j, unnest(range(1, k - j + 2)) AS i FROM often, range(2, 5) AS s(j) WHERE j < k)),
    left_ AS (SELECT best.*, array_to_string(g, ' ') AS phrase FROM best WHERE NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.lang = best.lang AND inner_.g = best.g AND inner_.c >= best.c))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, c DESC, encode(phrase)) AS rank, phrase, c AS a, l, r, n, score FROM left_ QUALIFY rank <= 2000"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_sql() -> str:
    """Three rounds and the last assignment, one step at a time."""
    near = "(SELECT r, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, v, c, list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM kept, {centres}) GROUP BY r)"
    steps = []
    for i in range(centroids.ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED {near.format(centres=f'c{i}')}")
        steps.append(f"s{i} AS (SELECT c, k, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({centroids.DIMENSIONS})) AS k FROM a{i}) GROUP BY c, k)")
        steps.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS m FROM s{i} GROUP BY c)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c))")
    last = centroids.ROUNDS
    return f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT {centroids.CENTROIDS}),
    {", ".join(steps)},
    final AS MATERIALIZED {near.format(centres=f"c{last}")}
    SELECT vec_id, final.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY final.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM final JOIN kept USING (r) JOIN c{last} ON c{last}.c = final.c"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quote_links, op2_best_fit_packing, op3_quality_rules, op4_repeated_passages, op5_toxicity, op6_temperature_mixing, op7_pii, op8_near_dedup, op9_line_dedup, op10_exact_dedup, op11_collocations, op12_centroids, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quote_links": OP1_SQL, "op3_quality_rules": op3_sql(), "op6_temperature_mixing": f"SELECT * EXCLUDE (row_) FROM ({mix_sql('documents')})", "op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_centroids": op12_sql()}
