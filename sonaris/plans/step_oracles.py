"""DuckDB SQL for the queries of single steps, over the same tables."""

from __future__ import annotations

from sonaris.plans.oracles import _EV, _LG, _SC, _SEQ, _r
from sonaris.plans.step_queries import MESSAGES, TEMPO

_NAME = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MESSAGES.items()) + " END"
_OP = _EV + f""", o1 AS (SELECT event_id, file_id, kind, seq, time - min(time) OVER (PARTITION BY file_id) AS t, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY track) - 1 AS INTEGER) AS track, {_NAME} AS event,
    CASE WHEN kind <> 'signup' THEN channel END AS channel, CASE WHEN kind = 'signup' THEN {TEMPO} + v * 1000 ELSE v % 128 END AS a, CASE WHEN kind IN ('click', 'purchase', 'error') THEN 64 END AS b FROM ev),
op AS (SELECT * REPLACE (row_number() OVER w - 1 AS seq), t - lag(t, 1, 0) OVER w AS delta FROM o1 WINDOW w AS (PARTITION BY file_id, track ORDER BY t, seq))"""


def _kept(where: str) -> str:
    """Some events alone: their deltas summed up."""
    return _OP + f", f AS (SELECT *, sum(delta) OVER (PARTITION BY file_id, track ORDER BY seq) AS t2 FROM op WHERE {where})"


_NT = _EV + """, nt AS (SELECT file_id, event_id, time % 86400 AS start, v * 40 + 1 AS dur, channel, v % 128 AS pitch, event_id % 128 AS velocity, v % 7 AS patch FROM ev)"""


def _distinct(divider: int, dur: str = "dur") -> str:
    return _NT + f""", qn AS (SELECT * REPLACE (CAST(round_even(start / {divider}.0::DOUBLE, 0) AS BIGINT) AS start, CAST(round_even({dur} / {divider}.0::DOUBLE, 0) AS BIGINT) AS dur) FROM nt),
    dp AS (SELECT * FROM qn QUALIFY row_number() OVER (PARTITION BY file_id, start, pitch ORDER BY dur DESC, velocity DESC, channel) = 1),
    rb AS (SELECT * REPLACE (start - min(start) OVER (PARTITION BY file_id) AS start) FROM dp)"""


_TABLE = """c0 AS (SELECT CAST(m AS INTEGER) AS m, list_filter(range(12), lambda x: (m >> x) & 1 = 1) AS pcs FROM range(1, 4096) t(m) WHERE m & (((m << 1) | (m >> 11)) & 4095) = 0),
c1 AS (SELECT m, len(pcs) AS n, CAST(row_number() OVER (ORDER BY pcs) - 1 AS INTEGER) AS id FROM c0),
tb AS (SELECT CAST(k AS INTEGER) AS mask, id AS chord_id, m AS chord_mask FROM range(1, 4096) r(k) JOIN c1 ON m & k = m QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, id) = 1)"""
_CH = _distinct(1800, "dur * 600") + f""", {_TABLE},
ch AS (SELECT file_id, start, list(struct_pack(p := pitch, d := dur) ORDER BY pitch DESC) AS notes, CAST(bit_or(1 << (pitch % 12)) AS INTEGER) AS mask FROM rb GROUP BY ALL),
rp AS (SELECT file_id, start, chord_id, CASE WHEN len(notes) > 1 THEN list_filter(notes, lambda n: (chord_mask & (1 << (n.p % 12))) <> 0) ELSE notes END AS notes FROM ch JOIN tb USING (mask)),
pt AS (SELECT *, greatest(0, least(127, coalesce(start - lag(start) OVER (PARTITION BY file_id ORDER BY start), 0))) AS delta, CASE WHEN len(notes) = 1 THEN notes[1].p % 12 + 384 ELSE chord_id + 396 END AS kind FROM rp)"""

_TURNS = "tn AS (SELECT conv_id || '-' || turn AS seq_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS w FROM conversations)"
_ATT = """aw AS (SELECT vec_id // 10 AS seq_id, CAST(vec_id % 10 AS INTEGER) AS i, (generate_subscripts(embedding, 1) - 1) AS d, abs(unnest(embedding)::DOUBLE) AS w FROM embeddings),
a AS (SELECT seq_id, d // 20 AS layer, d // 10 % 2 AS head, i, CAST(d % 10 AS INTEGER) AS j, w FROM aw WHERE d < 40)"""
_U = "('0x' || left(md5('0/' || seq_id || '/{}/' || i), 8))::UBIGINT / 4294967296"


def oracle_sql() -> dict[str, str]:
    """SQL by the name of its query."""
    out: dict[str, str] = {}
    out["midi_round_trip"] = f"WITH {_OP} SELECT file_id, 96 AS ticks, track, seq, event, delta, channel, a, b FROM op"
    out["midi_message_counts"] = f"WITH {_OP} SELECT file_id, 96 AS ticks, count(*) AS n_events, string_agg(DISTINCT event, ',' ORDER BY event) AS kinds, 0 AS n_warnings FROM op GROUP BY file_id"
    out["score_opus"] = f"""WITH {_SC}, x AS (SELECT event_id, file_id, track, CASE event WHEN 'note' THEN 'note_on' ELSE event END AS event, seq * 2 AS k, time AS t, a FROM sc
        UNION ALL SELECT event_id, file_id, track, 'note_off', seq * 2 + 1, time + dur, a FROM sc WHERE event = 'note')
        SELECT event_id, event, track, row_number() OVER w - 1 AS seq, t - lag(t, 1, 0) OVER w AS delta, a, 64 AS b FROM x WINDOW w AS (PARTITION BY file_id, track ORDER BY t, k)"""
    out["mixed_tracks"] = f"WITH {_kept('''event NOT LIKE 'note%' ''')} SELECT event_id, 0 AS track, row_number() OVER w - 1 AS seq, CAST(t2 - lag(t2, 1, 0) OVER w AS BIGINT) AS delta FROM f WINDOW w AS (PARTITION BY file_id ORDER BY t2, track, seq)"
    out["common_ticks"] = f"""WITH {_kept("event <> 'set_tempo'")}, g AS (SELECT *, CASE WHEN file_id::INT % 2 = 0 THEN 96 ELSE 48 END AS ticks, file_id::INT // 2 AS pair FROM f),
        h AS (SELECT *, min(ticks) OVER p <> max(ticks) OVER p AS mixed, t2 * 500000 / (ticks * 1000.0::DOUBLE) AS exact FROM g WINDOW p AS (PARTITION BY pair))
        SELECT event_id, CAST(CASE WHEN mixed THEN 1000 ELSE ticks END AS INTEGER) AS ticks, CAST(CASE WHEN mixed THEN round_even(exact - lag(exact, 1, 0.0::DOUBLE) OVER w, 0) ELSE t2 - lag(t2, 1, 0) OVER w END AS BIGINT) AS delta
        FROM h WINDOW w AS (PARTITION BY file_id, track ORDER BY t2, seq)"""
    out["score_kinds"] = f"""WITH {_EV}, x AS (SELECT file_id, arg_min(track, (track, seq)) FILTER (kind IN ('click', 'purchase')) AS first FROM ev GROUP BY file_id)
        SELECT file_id, CASE WHEN first IS NULL THEN '' WHEN first % 2 = 0 THEN 'score' ELSE 'opus' END AS kind FROM x"""
    out["file_lengths"] = f"WITH {_OP} SELECT file_id, CAST(sum(delta) AS BIGINT) AS nticks FROM op GROUP BY file_id"
    out["bank_selects"] = f"""WITH {_EV}, e AS (SELECT file_id, channel, time, track, seq, CASE WHEN v % 2 = 0 THEN 0 ELSE 32 END AS a, v % 128 AS b FROM ev WHERE kind = 'error'),
        n AS (SELECT *, lead(a) OVER w AS na, lead(b) OVER w AS nb, lag(a) OVER w AS pa FROM e WINDOW w AS (PARTITION BY file_id, channel ORDER BY time, track, seq)),
        p AS (SELECT DISTINCT file_id, CASE WHEN a = 0 THEN b ELSE -1 END AS msb, CASE WHEN a = 32 THEN b WHEN na = 32 THEN nb ELSE -1 END AS lsb FROM n WHERE a = 0 OR coalesce(pa, 32) <> 0)
        SELECT file_id, string_agg(msb || ':' || lsb, ' ' ORDER BY msb, lsb) AS selects FROM p GROUP BY file_id"""
    out["quantized_notes"] = f"WITH {_NT} SELECT event_id, CAST(round_even(start / 32.0::DOUBLE, 0) AS BIGINT) AS start, CAST(round_even(dur / 32.0::DOUBLE, 0) AS BIGINT) AS dur FROM nt"
    out["piano_notes"] = f"WITH {_NT} SELECT event_id, 0 AS channel, 0 AS patch FROM nt WHERE patch IN (0, 2, 5) AND channel <> 9"
    out["distinct_pitch_notes"] = f"WITH {_distinct(3600)} SELECT file_id, start, pitch, dur, velocity FROM dp"
    out["fixed_durations"] = f"WITH {_distinct(3600)} SELECT file_id, start, pitch, greatest(1, least(5, coalesce(lead(start) OVER (PARTITION BY file_id, pitch ORDER BY start) - start, 5))) AS dur FROM rb"
    out["transposed_notes"] = f"WITH {_NT} SELECT event_id, CAST(k AS INTEGER) AS variant, start - min(start) OVER (PARTITION BY file_id) AS start, CAST(pitch + k AS INTEGER) AS pitch FROM nt, range(-3, 3) r(k)"
    out["patched_notes"] = f"""WITH {_EV}, c AS (SELECT file_id, channel, time, max(v) AS patch FROM ev WHERE kind = 'view' GROUP BY ALL)
        SELECT n.event_id, coalesce(c.patch, -1) AS patch FROM (SELECT * FROM ev WHERE kind <> 'view') n ASOF LEFT JOIN c ON n.file_id = c.file_id AND n.channel = c.channel AND n.time >= c.time"""
    out["sustained_notes"] = f"""WITH {_EV}, p AS (SELECT file_id, channel, time, max(v) * 2 >= 90 AS d FROM ev WHERE kind = 'view' GROUP BY ALL),
        t AS (SELECT * FROM (SELECT *, coalesce(lag(d) OVER (PARTITION BY file_id, channel ORDER BY time), false) AS was FROM p) WHERE d <> was),
        s AS (SELECT *, lead(time) OVER (PARTITION BY file_id, channel ORDER BY time) AS until FROM t),
        n AS (SELECT event_id, file_id, channel, time, time + 60 AS fin, max(time + 60) OVER (PARTITION BY file_id, channel) AS final FROM ev WHERE kind = 'click')
        SELECT n.event_id, greatest(60, CASE WHEN s.d THEN coalesce(s.until, n.final) ELSE n.fin END - n.time) AS dur FROM n ASOF LEFT JOIN s ON n.file_id = s.file_id AND n.channel = s.channel AND n.fin >= s.time"""
    out["chord_table"] = f"WITH {_TABLE} SELECT mask, chord_id, chord_mask FROM tb"
    out["repaired_chords"] = f"WITH {_CH} SELECT file_id, start, chord_id, array_to_string(list_transform(notes, lambda n: n.p), ' ') AS pitches FROM rp"
    out["token_streams"] = f"""WITH {_CH}, x AS (SELECT file_id, start, list_concat([delta, kind], flatten(list_transform(notes, lambda n: [greatest(1, least(127, n.p)) + 128, greatest(1, least(127, n.d)) + 256]))) AS part FROM pt),
        y AS (SELECT file_id, flatten(list(part ORDER BY start)) AS tokens FROM x GROUP BY file_id) SELECT file_id, 0 AS variant, CAST(len(tokens) AS INTEGER) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM y"""
    out["decoded_notes"] = f"""WITH {_CH}, x AS (SELECT file_id, row_number() OVER w - 1 AS event, CAST(sum(delta) OVER w AS BIGINT) AS begun, kind, unnest(notes) AS n FROM pt WINDOW w AS (PARTITION BY file_id ORDER BY start))
        SELECT file_id, event, begun AS start, kind AS chord, greatest(1, least(127, n.p)) AS pitch, greatest(1, least(127, n.d)) AS dur FROM x"""
    out["corrupted_tokens"] = f"""WITH {_TURNS}, x AS (SELECT seq_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM tn),
        y AS (SELECT *, {_U.format('choose')} < 0.15 AS chosen, {_U.format('how')} AS how, {_U.format('token')} AS tok FROM x)
        SELECT seq_id, CAST(count(*) FILTER (chosen) AS INTEGER) AS n_chosen, md5(string_agg(CAST(CASE WHEN NOT chosen THEN t WHEN how < 0.8 THEN 718 WHEN how < 0.9 THEN CAST(floor(tok * 718) AS BIGINT) ELSE t END AS VARCHAR), ' ' ORDER BY i)) AS digest FROM y GROUP BY seq_id"""
    out["ended_sequences"] = f"WITH {_TURNS} SELECT seq_id, md5(array_to_string(list_transform(w, lambda t, i: CASE WHEN i > coalesce(nullif(list_position(w, 9), 0), len(w)) THEN 719 ELSE t END), ' ')) AS digest FROM tn"
    out["matching_tokens"] = f"WITH {_TURNS} SELECT CAST(max(len(list_filter(w, lambda t: t IN (2, 3, 5)))) AS INTEGER) AS n FROM tn"
    out["concat_pooled"] = f"""WITH {_SEQ}, k AS (SELECT *, dense_rank() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS r FROM u WHERE m AND token < 400),
        z AS (SELECT seq_id, CAST(d AS INTEGER) AS dim FROM (SELECT DISTINCT seq_id FROM u), range(192) g(d))
        SELECT z.seq_id, z.dim, {_r('coalesce(k.x, 0.0)')} AS value FROM z LEFT JOIN k ON k.seq_id = z.seq_id AND k.r < 3 AND k.r * 64 + k.dim = z.dim"""
    out["logit_accuracy"] = f"WITH {_LG}, t AS (SELECT vec_id, arg_max(i, (x, -i)) AS top FROM l GROUP BY vec_id) SELECT {_r('avg(CAST(top = label AS INTEGER))')} AS accuracy FROM t JOIN embeddings USING (vec_id)"
    out["binary_scores"] = f"SELECT vec_id, {_r('1 / (1 + exp(-embedding[1]::DOUBLE * 10))')} AS prob, CAST(1 / (1 + exp(-embedding[1]::DOUBLE * 10)) >= 0.5 AS INTEGER) AS pred FROM embeddings"
    out["generation_signals"] = f"""WITH {_LG}, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) AS rn FROM p),
        h AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id)) AS sim FROM embeddings),
        s AS (SELECT vec_id, 'entropy' AS metric, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS value FROM p GROUP BY vec_id UNION ALL SELECT vec_id, 'next_token_prob', p FROM p WHERE i = vec_id * 37 % 64
              UNION ALL SELECT vec_id, 'top_k_gap', max(p) FILTER (rn = 1) - max(p) FILTER (rn = 2) FROM o GROUP BY vec_id UNION ALL SELECT vec_id, 'hidden_cos_sim', sim FROM h)
        SELECT vec_id // 10 AS batch, vec_id % 10 AS step, metric, {_r('value')} AS value FROM s"""
    out["sequence_probabilities"] = """WITH y AS (SELECT vec_id, least(embedding[1]::DOUBLE * 6000 - 600, 0.0::DOUBLE) AS x FROM embeddings), x AS (SELECT vec_id, CASE WHEN x < -600 THEN x - 200 ELSE x END AS x FROM y)
        SELECT vec_id, CASE WHEN exp(x) = 0 THEN '~10^' || CAST(round(x / ln(10.0::DOUBLE)) AS BIGINT) ELSE format('{:.6e}', exp(x)) END AS shown FROM x"""
    out["penalised_logits"] = f"WITH {_LG} SELECT vec_id, CAST(i AS INTEGER) AS token, {_r('CASE WHEN i NOT IN (vec_id % 64, vec_id * 7 % 64) THEN x WHEN x > 0 THEN x / 1.3::DOUBLE ELSE x * 1.3::DOUBLE END')} AS value FROM l"
    out["biased_logits"] = f"WITH {_LG} SELECT vec_id, CAST(i AS INTEGER) AS token, {_r('(x + CASE i WHEN 3 THEN 1.5::DOUBLE WHEN 7 THEN -2.0 ELSE 0.0 END) / 0.7::DOUBLE')} AS value FROM l WHERE i NOT IN (0, 63)"
    out["batch_losses"] = f"""WITH v AS (SELECT vec_id // 10 AS batch, vec_id % 10 AS i, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT a.batch, a.i, (b.i + 9) % 10 AS j, list_dot_product(a.e, b.e) * 5 AS x FROM v a JOIN v b USING (batch)),
        r AS (SELECT *, ln(sum(exp(x)) OVER (PARTITION BY batch, i)) - x AS lr, ln(sum(exp(x)) OVER (PARTITION BY batch, j)) - x AS lc FROM s)
        SELECT batch, {_r('avg(lr)')} AS loss_rows, {_r('avg(lc)')} AS loss_columns, {_r('(avg(lr) + avg(lc)) / 2')} AS loss FROM r WHERE i = j GROUP BY batch"""
    out["batch_retrieval"] = f"""WITH v AS (SELECT vec_id // 10 AS batch, vec_id % 10 AS i, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT a.batch, a.i, (b.i + 9) % 10 AS j, round(list_dot_product(a.e, b.e), 9) AS x FROM v a JOIN v b USING (batch)),
        d AS (SELECT batch, 0 AS way, i AS a, j AS b, x FROM s UNION ALL SELECT batch, 1, j, i, x FROM s),
        k AS (SELECT batch, way, a, arg_max(b, struct_pack(x := x, b := -b)) AS best FROM d GROUP BY ALL),
        p AS (SELECT batch, way, best AS c, count(*) AS n FROM k GROUP BY ALL),
        o AS (SELECT y.batch, y.way, y.a, 1 + count(z.b) AS place FROM d y LEFT JOIN d z ON z.batch = y.batch AND z.way = y.way AND z.a = y.a AND (z.x > y.x OR z.x = y.x AND z.b < y.b) WHERE y.a = y.b GROUP BY ALL)
        SELECT o.batch, {_r('avg(CAST(place = 1 AS INTEGER))')} AS recall_at_1, {_r('avg(CAST(place <= 5 AS INTEGER))')} AS recall_at_top, {_r('avg(CASE WHEN place <= 5 THEN 1.0 / place ELSE 0 END)')} AS mrr,
               {_r('avg(CASE WHEN place = 1 THEN 2.0 / (1 + n) ELSE 0 END)')} AS f1 FROM o LEFT JOIN p ON p.batch = o.batch AND p.way = o.way AND p.c = o.a GROUP BY o.batch"""
    out["share_summary"] = f"""WITH s AS (SELECT CAST(CAST(avg(CAST(role = 'assistant' AS INTEGER)) AS FLOAT) AS DOUBLE) AS share FROM conversations GROUP BY conv_id HAVING abs(CAST(avg(CAST(role = 'assistant' AS INTEGER)) AS FLOAT) - 0.5) <= 0.1 + 1e-7)
        SELECT count(*) AS n, {_r('avg(share)')} AS mean, {_r('stddev_pop(share)')} AS std, {_r('min(share)')} AS min, {_r('max(share)')} AS max FROM s"""
    out["attention_received"] = f"WITH {_ATT} SELECT seq_id, j AS pos, {_r('sum(w) / 2')} AS score FROM a GROUP BY seq_id, j"
    mix = "SELECT seq_id, i, j, sum(w) AS w FROM (SELECT seq_id, i, j, w * 0.5 AS w FROM m WHERE layer = {} UNION ALL SELECT seq_id, n, n, 0.5 FROM n) GROUP BY ALL"
    out["attention_rollout"] = f"""WITH {_ATT}, m AS (SELECT seq_id, layer, i, j, avg(w) AS w FROM a GROUP BY ALL), n AS (SELECT seq_id, i AS n FROM a UNION SELECT seq_id, j FROM a), x AS ({mix.format(0)}), y AS ({mix.format(1)})
        SELECT y.seq_id, x.j AS pos, {_r('sum(y.w * x.w)')} AS score FROM y JOIN x ON y.seq_id = x.seq_id AND y.j = x.i GROUP BY y.seq_id, x.j"""
    out["occluded_variants"] = """WITH c AS (SELECT conv_id AS seq_id, list(length(coalesce(text, '')) ORDER BY turn, length(coalesce(text, ''))) AS w FROM conversations GROUP BY conv_id)
        SELECT seq_id, CAST(k AS INTEGER) AS a, array_to_string(list_transform(w, lambda t, i: CASE WHEN i = k + 1 THEN 718 ELSE t END), ' ') AS tokens FROM (SELECT *, unnest(range(len(w))) AS k FROM c)"""
    out["occlusion"] = f"""WITH u AS (SELECT vec_id // 10 AS seq_id, vec_id % 10 AS a, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
        SELECT o.seq_id, o.a, {_r('avg((o.x - b.x) * (o.x - b.x))')} AS score FROM u o JOIN u b ON b.seq_id = o.seq_id AND b.d = o.d AND b.a = 0 WHERE o.a > 0 GROUP BY o.seq_id, o.a"""
    out["prediction_surprise"] = f"WITH {_LG} SELECT vec_id // 10 AS seq_id, vec_id % 10 AS pos, {_r('-ln(p)')} AS score FROM p WHERE i = vec_id * 37 % 64"
    out["pair_synergy"] = f"""WITH e AS (SELECT vec_id // 10 AS seq_id, vec_id % 10 AS a, embedding::DOUBLE[] AS v FROM embeddings),
        p AS (SELECT x.seq_id, x.a, y.a AS b, greatest(0.0, x.v[2] + y.v[3] - x.v[1] - y.v[1]) AS extra FROM e x JOIN e y ON x.seq_id = y.seq_id AND x.a < y.a)
        SELECT seq_id, pos, {_r('avg(extra)')} AS score FROM (SELECT seq_id, a AS pos, extra FROM p UNION ALL SELECT seq_id, b, extra FROM p) GROUP BY seq_id, pos"""
    out["valid_topk"] = "SELECT vec_id // 10 AS seq_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id % 10 AS pos FROM embeddings WHERE vec_id % 7 <> 0 WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY embedding[1] DESC, vec_id) QUALIFY row_number() OVER w <= 3"
    out["int16_samples"] = "SELECT event_id, CAST(trunc(coalesce((value - 50) / nullif(max(abs(value - 50)) OVER (PARTITION BY user_id), 0) * 32767, 0)) AS INTEGER) AS sample FROM events"
    out["sample_schedule"] = f"""WITH {_OP}, x AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(last_value(CASE WHEN event = 'set_tempo' THEN a END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY t, track, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 500000) AS tempo,
            t - lag(t, 1, 0) OVER w AS gap FROM op WINDOW w AS (PARTITION BY file_id ORDER BY t, track, seq)),
        y AS (SELECT *, CAST(trunc((gap * tempo)::DOUBLE / 96 / 1e6::DOUBLE * 1600) AS BIGINT) AS wait FROM x)
        SELECT event_id, place, tempo, wait, CAST(sum(wait) OVER (PARTITION BY file_id ORDER BY place) AS BIGINT) AS sample FROM y"""
    out["pca_reduced_norms"] = """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY d) AS x FROM u)
        SELECT vec_id, round(sum(x * x), 4) AS square FROM c GROUP BY vec_id"""
    return out
