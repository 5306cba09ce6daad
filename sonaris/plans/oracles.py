"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

_R6 = "round({}, 6) + 0.0"


def _r(x: str) -> str:
    return _R6.format(x)


def _topk(q: str, c: str, k: int, sim: str = "round(list_cosine_similarity(q.v, c.v), 12)", where: str = "true") -> str:
    return f"""SELECT query_id, rank, corpus_id, {_r('sim')} AS sim FROM (
        SELECT q.id AS query_id, c.id AS corpus_id, {sim} AS sim, CAST(row_number() OVER (PARTITION BY q.id ORDER BY {sim} DESC, c.id) AS INTEGER) AS rank
        FROM ({q}) q JOIN ({c}) c ON {where}) WHERE rank <= {k}"""


def _v(where: str) -> str:
    return f"SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where}"


#: Token sequences of ten vectors, one row a component.
_SEQ = """u AS (SELECT vec_id // 10 AS seq_id, vec_id % 10 AS pos, vec_id * 37 % 720 AS token, vec_id % 7 <> 0 AS m, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"""
_WEIGHT = "CASE WHEN token >= 384 THEN 1.5 WHEN token >= 256 THEN 0.5 WHEN token >= 128 THEN 2.0 ELSE 1.0 END"

_EV = """ev AS (SELECT CAST(user_id // 10 AS VARCHAR) AS file_id, CAST(user_id AS INTEGER) AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type AS kind,
    CAST(floor(epoch(ts)) AS BIGINT) AS time, CAST(user_id % 12 AS INTEGER) AS channel, CAST(floor(value) AS INTEGER) AS v, event_id, value FROM events)"""
_SC = _EV + """, sc AS (SELECT *, CASE kind WHEN 'signup' THEN 'set_tempo' WHEN 'view' THEN 'patch_change' WHEN 'error' THEN 'control_change' ELSE 'note' END AS event,
    CASE WHEN kind IN ('click', 'purchase') THEN 5 END AS dur, v % 128 AS a FROM ev)"""
_REBASED = _SC + ", rb AS (SELECT * REPLACE (time - min(time) OVER (PARTITION BY file_id) AS time) FROM sc)"

#: Logits, one row a token, with probabilities.
_LG = """l AS (SELECT vec_id, unnest(embedding)::DOUBLE * 10 AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT *, exp(x - max(x) OVER w) / sum(exp(x - mx)) OVER w AS p FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS mx FROM l) WINDOW w AS (PARTITION BY vec_id))"""


def _kept(where: str, extra: str = "") -> str:
    return f"""WITH {_LG}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn, max(p) OVER (PARTITION BY vec_id) AS pm{extra} FROM p)
    SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS kept FROM r WHERE {where} GROUP BY vec_id"""


_SIGNALS = """s AS (SELECT vec_id // 10 AS seq_id, CAST(vec_id % 10 AS INTEGER) AS pos, unnest(['occlusion', 'prediction', 'attention']) AS signal, unnest([embedding[1], embedding[2], embedding[3]])::DOUBLE AS score FROM embeddings),
r AS (SELECT *, (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-8) AS scaled, CAST(row_number() OVER (PARTITION BY seq_id, signal ORDER BY score, pos DESC) - 1 AS INTEGER) AS points FROM s WINDOW w AS (PARTITION BY seq_id, signal))"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    all_rows, due, labelled = _v("true"), _v("vec_id % 20 = 0"), "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"
    out["cosine_topk"] = _topk(due, all_rows, 16)
    out["dot_topk"] = _topk(due, all_rows, 16, "round(list_dot_product(q.v, c.v), 12)")
    out["knn_self"] = _topk(all_rows, all_rows, 10, where="q.id <> c.id")
    out["knn_pairwise"] = _topk(labelled, labelled, 5, where="q.label <> c.label")
    out["variant_ranked_matches"] = f"""
        WITH t AS (SELECT q.id - q.id % 20 AS piece, q.id % 20 AS query_id, c.id AS corpus_id, round(list_cosine_similarity(q.v, c.v), 12) AS sim FROM ({_v('vec_id % 20 < 12')}) q JOIN ({all_rows}) c ON true),
        k AS (SELECT *, row_number() OVER (PARTITION BY piece, query_id ORDER BY sim DESC, corpus_id) AS rank FROM t QUALIFY rank <= 16),
        d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY piece, corpus_id ORDER BY sim DESC, query_id, rank) = 1)
        SELECT piece, CAST(row_number() OVER (PARTITION BY piece ORDER BY sim DESC, query_id, rank) - 1 AS INTEGER) AS place, 'piece-' || corpus_id AS name, CAST(query_id - 6 AS INTEGER) AS variant, {_r('sim * 100')} AS score FROM d"""
    out["underfull_topk"] = f"""
        WITH t AS ({_topk(due, all_rows, 64)}), s AS (SELECT vec_id AS query_id, CAST(r AS INTEGER) AS rank FROM embeddings, range(1, 65) b(r) WHERE vec_id % 20 = 0)
        SELECT s.query_id, s.rank, coalesce(corpus_id, -1) AS corpus_id, sim FROM s LEFT JOIN t USING (query_id, rank)"""
    out["heatmap"] = f"""
        WITH t AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM ({due}) a JOIN ({all_rows}) b ON true),
        g AS (SELECT *, sign(sim) * pow(abs(sim), 0.55) AS bent FROM t), e AS (SELECT quantile_cont(bent, 0.02) AS lo, quantile_cont(bent, 0.98) AS hi FROM g)
        SELECT a, b, {_r('sim')} AS sim, {_r('greatest(lo, least(hi, bent))')} AS shown FROM g, e"""
    out["retrieval_quality"] = f"""
        WITH t AS ({_topk(due, all_rows, 5, where='q.id <> c.id')}), n AS (SELECT count(*) AS n FROM embeddings),
        g AS (SELECT vec_id AS query_id, (vec_id + 250) % n AS own FROM embeddings, n WHERE vec_id % 20 = 0),
        h AS (SELECT g.query_id, rank AS hit FROM g LEFT JOIN t ON t.query_id = g.query_id AND t.corpus_id = own),
        f AS (SELECT query_id, own, corpus_id AS pred FROM g JOIN t USING (query_id) WHERE rank = 1),
        c AS (SELECT own AS c, CAST(own = pred AS INTEGER) AS tp FROM f UNION ALL SELECT pred, 0 FROM f),
        m AS (SELECT avg(s) AS macro_f1 FROM (SELECT c, 2 * sum(tp) / count(*) AS s FROM c GROUP BY c))
        SELECT {_r('avg(CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END)')} AS r_at_1, {_r('avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END)')} AS r_at_k, {_r('avg(coalesce(1.0 / hit, 0.0))')} AS mrr, {_r('any_value(macro_f1)')} AS macro_f1 FROM h, m"""
    out["mean_pool"] = f"WITH {_SEQ} SELECT seq_id, CAST(dim AS INTEGER) AS dim, {_r('sum(CASE WHEN m THEN x ELSE 0 END) / greatest(sum(CAST(m AS INTEGER)), 1e-9)')} AS value FROM u GROUP BY ALL"
    out["weighted_mean_pool"] = f"WITH {_SEQ} SELECT seq_id, CAST(dim AS INTEGER) AS dim, {_r(f'sum(CASE WHEN m THEN {_WEIGHT} * x ELSE 0 END) / greatest(sum(CASE WHEN m THEN {_WEIGHT} ELSE 0 END), 1e-6)')} AS value FROM u GROUP BY ALL"
    out["aggregated_pool"] = f"""
        WITH {_SEQ}, g AS (SELECT * FROM (VALUES (0, 0, 128, 1.0), (1, 128, 256, 2.0), (2, 256, 384, 0.5), (3, 384, 720, 1.5)) AS g(k, lo, hi, w))
        SELECT seq_id, CAST(k * 64 + dim AS INTEGER) AS dim, {_r('any_value(w) * sum(CASE WHEN m AND token >= lo AND token < hi THEN x ELSE 0 END) / greatest(sum(CAST(m AND token >= lo AND token < hi AS INTEGER)), 1e-6)')} AS value
        FROM u, g GROUP BY seq_id, k, dim"""
    out["selected_mean_pool"] = f"""
        WITH {_SEQ}, n AS (SELECT *, m AND token IN (0, 37, 74) AS own, sum(CAST(m AND token IN (0, 37, 74) AS INTEGER)) OVER (PARTITION BY seq_id) AS any_own FROM u)
        SELECT seq_id, CAST(dim AS INTEGER) AS dim, {_r('sum(CASE WHEN (CASE WHEN any_own > 0 THEN own ELSE m END) THEN x ELSE 0 END) / greatest(sum(CAST(CASE WHEN any_own > 0 THEN own ELSE m END AS INTEGER)), 1e-9)')} AS value FROM n GROUP BY ALL"""
    out["pad_mask"] = """
        WITH t AS (SELECT conv_id, turn, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS w FROM conversations), x AS (SELECT *, max(len(w)) OVER () AS n FROM t)
        SELECT conv_id, turn, array_to_string(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: CASE WHEN i <= len(w) THEN w[i] ELSE 719 END), ' ') AS padded, CAST(len(w) AS INTEGER) AS n_valid FROM x"""
    out["ngram_mask"] = """
        WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS i FROM documents),
        g AS (SELECT *, substr(sha256('0/' || doc_id || '/' || (i // 4)), CAST(i % 4 * 16 + 1 AS BIGINT), 16) AS h FROM t),
        u AS (SELECT doc_id, i, length(w) AS n, ('0x' || left(h, 6))::UBIGINT / 16777216 AS us, ('0x' || substr(h, 7, 6))::UBIGINT / 16777216 AS un, ('0x' || substr(h, 13, 4))::UBIGINT * 4 // 65536 + 2 AS l FROM g),
        c AS (SELECT doc_id, i, CASE WHEN us < 0.1 OR coalesce(max(CASE WHEN un < 0.1 THEN i + l END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > i, false) THEN 718 ELSE n END AS k FROM u)
        SELECT doc_id, CAST(sum(CAST(k = 718 AS INTEGER)) AS INTEGER) AS n_masked, md5(string_agg(CAST(k AS VARCHAR), ' ' ORDER BY i)) AS digest FROM c GROUP BY doc_id"""
    out["char_tokens"] = "SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: octet_length(encode(c)) = 1), lambda c: ascii(c)), ' ') AS tokens FROM conversations"
    out["delta_encode"] = f"WITH {_EV} SELECT event_id, track, row_number() OVER w - 1 AS seq, time - lag(time, 1, 0) OVER w AS delta FROM ev WINDOW w AS (PARTITION BY file_id, track ORDER BY time, seq)"
    out["absolute_times"] = f"WITH {_EV} SELECT event_id, time FROM ev"
    out["fifo_note_pairs"] = f"""
        WITH {_EV}, m AS (SELECT *, CASE kind WHEN 'click' THEN 1 ELSE -1 END AS step, max(time) OVER (PARTITION BY track) AS fin FROM ev WHERE kind IN ('click', 'purchase')),
        s AS (SELECT *, sum(step) OVER (PARTITION BY track ORDER BY time, seq) AS level FROM m),
        b AS (SELECT *, coalesce(min(level) OVER (PARTITION BY track ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
        n AS (SELECT *, row_number() OVER (PARTITION BY track, step ORDER BY time, seq) AS nth FROM b WHERE NOT (step = -1 AND level < least(0, before)))
        SELECT a.track, a.time AS start, coalesce(z.time, a.fin) - a.time AS dur FROM n a LEFT JOIN n z ON a.track = z.track AND a.nth = z.nth AND z.step = -1 WHERE a.step = 1"""
    out["grep_channels"] = f"WITH {_EV} SELECT event_id, channel, time FROM ev WHERE channel IN (0, 3, 7)"
    out["time_shift"] = f"WITH {_REBASED} SELECT event_id, CASE WHEN track NOT IN (9, 11) AND time >= 100000 AND event <> 'set_tempo' THEN time + 600 ELSE time END AS time FROM rb"
    out["segment_restore"] = f"""
        WITH {_REBASED}, own AS (SELECT * FROM rb WHERE track <> 9), i AS (SELECT * FROM own WHERE time BETWEEN 500000 AND 900000), alive AS (SELECT DISTINCT file_id, track FROM i),
        past AS (SELECT * FROM own WHERE time <= 500000 AND event IN ('set_tempo', 'patch_change', 'control_change')),
        st AS (SELECT file_id, track, event, channel, arg_max(a, (time, seq)) AS a FROM past GROUP BY ALL)
        SELECT file_id, track, event, time, channel, a, false AS restored FROM i
        UNION ALL SELECT file_id, track, event, 500000, channel, a, true FROM st SEMI JOIN alive USING (file_id, track)
        UNION ALL SELECT file_id, track, 'set_tempo', 500000, NULL, 500000, true FROM alive WHERE (file_id, track) NOT IN (SELECT (file_id, track) FROM past WHERE event = 'set_tempo')"""
    out["concat_scores"] = f"""
        WITH {_SC}, t AS (SELECT * REPLACE (time - min(time) OVER (PARTITION BY track) AS time) FROM sc), e AS (SELECT track, max(time + coalesce(dur, 0)) AS fin FROM t GROUP BY track),
        o AS (SELECT track, coalesce(sum(fin) OVER (ORDER BY track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM e)
        SELECT event_id, CAST(time + shift AS BIGINT) AS time FROM t JOIN o USING (track)"""
    out["mix_scores"] = f"WITH {_SC} SELECT event_id, 0 AS track, row_number() OVER (PARTITION BY file_id ORDER BY track, seq) - 1 AS seq FROM sc"
    out["merge_channels"] = "SELECT event_id, CAST([0, 1, 2, 3, 4, 5, 6, 7, 8, 10][user_id % 10 + 1] AS INTEGER) AS channel FROM events"
    out["tempo_to_ms"] = f"""
        WITH {_SC}, t AS (SELECT * REPLACE (time - min(time) OVER (PARTITION BY file_id) AS time) FROM sc WHERE event <> 'patch_change'),
        c AS (SELECT file_id, time, arg_max(250000 + v * 1000, (track, seq)) AS us FROM t WHERE event = 'set_tempo' GROUP BY file_id, time),
        d AS (SELECT *, (time - coalesce(lag(time) OVER w, 0)) * coalesce(lag(us) OVER w, 500000) AS part FROM c WINDOW w AS (PARTITION BY file_id ORDER BY time)),
        m AS (SELECT *, CAST(sum(part) OVER (PARTITION BY file_id ORDER BY time) AS BIGINT) AS done FROM d),
        x AS (SELECT t.event_id, t.track, t.file_id, t.seq, t.time, (coalesce(m.done, 0) + (t.time - coalesce(m.time, 0)) * coalesce(m.us, 500000)) / (96 * 1000.0::DOUBLE) AS exact
              FROM (SELECT * FROM t WHERE event <> 'set_tempo') t ASOF LEFT JOIN m ON t.file_id = m.file_id AND t.time >= m.time)
        SELECT event_id, CAST(round_even(exact - coalesce(lag(exact) OVER (PARTITION BY file_id, track ORDER BY time, seq), 0.0), 0) AS BIGINT) AS ms FROM x"""
    out["event_stats"] = f"""
        WITH {_SC}, tr AS (SELECT file_id, track, coalesce(max(a) FILTER (event = 'note' AND channel <> 9), 0) - coalesce(min(a) FILTER (event = 'note' AND channel <> 9), 0) AS span FROM sc GROUP BY ALL),
        ch AS (SELECT file_id, string_agg(channel || ':' || n, ',' ORDER BY channel) AS notes_by_channel FROM (SELECT file_id, channel, count(*) AS n FROM sc WHERE event = 'note' GROUP BY ALL) GROUP BY file_id),
        cs AS (SELECT file_id, string_agg(CAST(channel AS VARCHAR), ',' ORDER BY channel) AS channels FROM (SELECT DISTINCT file_id, channel FROM sc) GROUP BY file_id)
        SELECT file_id, max(time + coalesce(dur, 0)) AS nticks, count(*) FILTER (event = 'note') AS num_notes, coalesce(any_value(notes_by_channel), '') AS notes_by_channel, any_value(channels) AS channels,
               CAST((SELECT sum(span) FROM tr WHERE tr.file_id = sc.file_id) AS BIGINT) AS pitch_range_sum
        FROM sc LEFT JOIN ch USING (file_id) LEFT JOIN cs USING (file_id) GROUP BY file_id"""
    out["chord_classes"] = f"""WITH {_EV} SELECT file_id, CAST(time // 3600 AS BIGINT) AS start, CAST(count(*) AS INTEGER) AS n, CAST(list_sum(list_transform(list_distinct(list(v % 128 % 12)), lambda p: 1 << p)) AS INTEGER) AS mask FROM ev GROUP BY ALL"""
    out["content_hash_dupes"] = "SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, md5(lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n]+', ' ', 'g'), ' '))) AS hash FROM documents) GROUP BY hash HAVING count(*) > 1"
    out["audio_normalize"] = f"""WITH s AS (SELECT event_id, value - 50 AS x, sqrt(avg((value - 50) * (value - 50)) OVER (PARTITION BY user_id)) AS size FROM events)
        SELECT event_id, {_r('greatest(-1.0, least(1.0, x * (pow(10.0, -1.0) / greatest(size, 1e-9))))')} AS normalized FROM s"""
    out["audio_trim"] = """WITH s AS (SELECT *, stddev_pop(abs(value)) OVER (PARTITION BY user_id) * 3.0 AS level FROM events), m AS (SELECT user_id, max(event_id) AS last FROM s WHERE abs(value) > level GROUP BY user_id)
        SELECT event_id FROM s JOIN m USING (user_id) WHERE event_id <= last"""
    out["windowed_counts"] = f"SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, {_r('sum(value)')} AS total FROM events GROUP BY 1, 2"
    out["pca_covariance"] = """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
        SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.x, b.x), 9) + 0.0 AS cov FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i"""
    out["softmax_entropy"] = f"WITH {_LG} SELECT vec_id, {_r('-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)')} AS entropy, {_r('max(p)')} AS top_prob, CAST(arg_max(i, (x, -i)) AS INTEGER) AS top_token FROM p GROUP BY vec_id"
    out["filter_top_k"] = _kept("rn <= ceil(0.1 * 64)")
    out["filter_top_p"] = _kept("before <= 0.9", ", coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    out["filter_top_a"] = _kept("p >= 0.2 * pow(pm, 2.0)")
    out["filter_min_p"] = _kept("p >= 0.1 * pm")
    out["contrastive_logits"] = f"""WITH {_LG}, e AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS xm FROM l)
        SELECT e.vec_id, CAST(e.i AS INTEGER) AS token, {_r('1.5 * e.x - 0.5 * a.x')} AS value FROM e JOIN l a ON a.vec_id = e.vec_id + 1 AND a.i = e.i WHERE e.x >= ln(0.1) + xm"""
    out["sequence_scores"] = f"""
        WITH {_LG}, s AS (SELECT vec_id, vec_id // 10 AS seq_id, lead(vec_id * 37 % 64) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS target FROM embeddings),
        t AS (SELECT vec_id, arg_max(i, (x, -i)) AS top FROM l GROUP BY vec_id),
        g AS (SELECT s.seq_id, ln(greatest(p.p, 1e-45)) AS lp, CAST(top = target AS INTEGER) AS hit FROM s JOIN p ON p.vec_id = s.vec_id AND p.i = s.target JOIN t ON t.vec_id = s.vec_id)
        SELECT seq_id, count(*) AS n, {_r('sum(lp)')} AS total_log_prob, {_r('sum(lp) / count(*)')} AS avg_log_prob, {_r('sum(lp) / count(*) / ln(2.0)')} AS avg_log_prob_bits, {_r('exp(sum(lp) / count(*))')} AS geometric_mean_prob,
               {_r('exp(-sum(lp) / count(*))')} AS perplexity, {_r('avg(hit)')} AS accuracy FROM g GROUP BY seq_id"""
    out["metric_anomalies"] = f"""WITH z AS (SELECT event_id AS step, event_type AS metric, value, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type))
        SELECT step, metric, CASE WHEN metric = 'click' AND value > 150 THEN 'above' ELSE 'outlier' END AS anomaly, {_r('z')} AS z FROM z WHERE (metric = 'click' AND value > 150) OR abs(z) > 2"""
    out["metric_drift"] = f"""WITH h AS (SELECT event_type AS metric, value, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) * 2 / count(*) OVER (PARTITION BY event_type)) AS half FROM events)
        SELECT metric, {_r('avg(value)')} AS mean, {_r('min(value)')} AS min, {_r('max(value)')} AS max, {_r('stddev_samp(value)')} AS std, {_r('avg(value) FILTER (half = 0)')} AS first_half, {_r('avg(value) FILTER (half = 1)')} AS second_half FROM h GROUP BY metric"""
    out["signal_ranks"] = f"WITH {_SIGNALS} SELECT seq_id, pos, signal, {_r('scaled')} AS scaled, points FROM r"
    out["fused_attribution"] = f"""WITH {_SIGNALS}, q AS (SELECT *, points / greatest(max(points) OVER (PARTITION BY seq_id, signal), 1) AS ranked, CASE signal WHEN 'occlusion' THEN 1.0 WHEN 'prediction' THEN 0.7 ELSE 0.3 END::DOUBLE AS w FROM r)
        SELECT seq_id, pos, {_r('sum((ranked + scaled) / 2 * w) / sum(w)')} AS fused FROM q GROUP BY seq_id, pos"""
    out["balanced_filter"] = f"SELECT conv_id, {_r('CAST(CAST(avg(CAST(role = $$assistant$$ AS INTEGER)) AS FLOAT) AS DOUBLE)')} AS share FROM conversations GROUP BY conv_id HAVING abs(CAST(avg(CAST(role = 'assistant' AS INTEGER)) AS FLOAT) - 0.5) <= 0.1 + 1e-7"
    out["class_weights"] = f"""WITH c AS (SELECT CAST(k AS INTEGER) AS label, (SELECT count(*) FROM embeddings WHERE label = k) AS n FROM range(0, 12) r(k)), w AS (SELECT *, 1 / greatest(n, 1) AS x FROM c)
        SELECT label, n, {_r('least(x / min(x) OVER (), 50.0)')} AS weight FROM w"""
    out["focal_loss"] = f"WITH {_LG} SELECT {_r('avg(pow(1 - p, 2) * -ln(p))')} AS loss FROM p JOIN embeddings e USING (vec_id) WHERE i = label"
    out["unit_vectors"] = f"""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE * 3 + 1 AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
        SELECT vec_id, CAST(dim AS INTEGER) AS dim, {_r('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12)')} AS value FROM u"""
    return out
