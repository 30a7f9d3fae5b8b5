"""DuckDB SQL for the queries, put together from named parts."""

from __future__ import annotations

import re

#: name: (parts it needs, SQL)
PARTS: dict[str, tuple[str, str]] = {}


def part(name: str, needs: str, sql: str) -> None:
    PARTS[name] = (needs, sql)


def sql(needs: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0].split():
                add(n)
            order.append(name)

    for n in needs.split():
        add(n)
    return ("WITH " + ", ".join(f"{n} AS ({PARTS[n][1]})" for n in order) + " " if order else "") + body


_TOKENS = r"SELECT list_filter(list_transform(regexp_split_to_array(line, '\s+'), lambda x: lower(x)), lambda x: regexp_full_match(x, '[a-z'']{1,30}')) AS t FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM %s)"
part("toks", "", _TOKENS % "documents")
part("toks_c", "", _TOKENS % "conversations")
part("uni", "toks", "SELECT w, count(*) AS count FROM (SELECT unnest(t) AS w FROM toks) GROUP BY w")
_BI = "SELECT ctx, w, count(*) AS count FROM (SELECT unnest(t[1:len(t)-1]) AS ctx, unnest(t[2:len(t)]) AS w FROM %s WHERE len(t) >= 2) GROUP BY ctx, w"
part("uni_c", "toks_c", "SELECT w, count(*) AS count FROM (SELECT unnest(t) AS w FROM toks_c) GROUP BY w")
part("bi", "toks", _BI % "toks")
part("bi_c", "toks_c", _BI % "toks_c")
part("tri", "toks", "SELECT w1 || ' ' || w2 AS ctx, w, count(*) AS count FROM (SELECT unnest(t[1:len(t)-2]) AS w1, unnest(t[2:len(t)-1]) AS w2, unnest(t[3:len(t)]) AS w FROM toks WHERE len(t) >= 3) GROUP BY 1, 2")
part("four", "toks", "SELECT w1 || ' ' || w2 || ' ' || w3 AS ctx, w, count(*) AS count FROM (SELECT unnest(t[1:len(t)-3]) AS w1, unnest(t[2:len(t)-2]) AS w2, unnest(t[3:len(t)-1]) AS w3, unnest(t[4:len(t)]) AS w FROM toks WHERE len(t) >= 4) GROUP BY 1, 2")
for _g in ("bi", "bi_c", "tri", "four"):
    part(f"tot_{_g}", _g, f"SELECT ctx, sum(count)::BIGINT AS total, count(*) AS distinct_n FROM {_g} GROUP BY ctx")
    part(f"cont_{_g}", _g, f"SELECT w, count(*) / (SELECT count(*) FROM {_g}) AS p FROM {_g} GROUP BY w")
part("mle", "uni", "SELECT w, count, count / (SELECT sum(count)::BIGINT FROM uni) AS p FROM uni")

_KN = "greatest(count - 0.75::DOUBLE, 0::DOUBLE) / total + (0.75::DOUBLE * distinct_n / total) * %s AS raw"
for _g in ("bi", "bi_c"):
    part(f"kn_{_g}", f"tot_{_g} cont_{_g}", f"SELECT ctx, w, {_KN % 'p'}, total AS support FROM {_g} JOIN tot_{_g} USING (ctx) JOIN cont_{_g} USING (w)")


def top(name: str, k: int = 10) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY raw DESC, w) AS rank FROM {name}"
    return f"SELECT ctx, rank, w, round(raw / max(raw) OVER (PARTITION BY ctx), 4) AS score, support FROM ({ranked}) WHERE rank <= {k}"


part("kn2", "kn_bi", top("kn_bi"))
part("kn2_c", "kn_bi_c", top("kn_bi_c"))
part("tri_ctx", "tot_tri", "SELECT *, split_part(ctx, ' ', 2) AS short FROM tot_tri WHERE total >= 3")
part("kn_low", "kn_bi", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY raw DESC, w) AS rank FROM kn_bi) WHERE rank <= 10")
for _name, _ctx, _low in (("kn_tri", "tri_ctx", "kn_low"),):
    part(
        _name,
        f"tri {_ctx} {_low} cont_bi",
        f"SELECT ctx, w, {_KN % 'coalesce(low, p, 0)'}, total AS support FROM (SELECT ctx, w, max(count) AS count, max(low) AS low FROM (SELECT ctx, w, count, NULL::DOUBLE AS low FROM tri WHERE ctx IN (SELECT ctx FROM {_ctx}) "
        f"UNION ALL SELECT c.ctx, l.w, 0, l.raw FROM {_ctx} c JOIN {_low} l ON l.ctx = c.short) GROUP BY ctx, w) JOIN {_ctx} USING (ctx) LEFT JOIN cont_bi USING (w)",
    )
part("kn3", "kn_tri", top("kn_tri"))
part("kn_o3", "tri tot_tri kn_bi", f"SELECT g.ctx, g.w, {_KN % 'coalesce(l.raw, 0)'}, total AS support FROM tri g JOIN tot_tri t ON t.ctx = g.ctx LEFT JOIN kn_bi l ON l.ctx = split_part(g.ctx, ' ', 2) AND l.w = g.w")
part("kn_o4", "four tot_four kn_o3", f"SELECT g.ctx, g.w, {_KN % 'coalesce(l.raw, 0)'}, total AS support FROM four g JOIN tot_four t ON t.ctx = g.ctx LEFT JOIN kn_o3 l ON l.ctx = regexp_replace(g.ctx, '^[^ ]* ', '') AND l.w = g.w")

part("hist", "uni bi tri", "SELECT n, r, count(*) AS types FROM (SELECT 1 AS n, count AS r FROM uni UNION ALL SELECT 2, count FROM bi UNION ALL SELECT 3, count FROM tri) GROUP BY n, r")
#: Names that depend on the discounts, which come in two kinds: as they are, and with _tb behind the name by the textbook.
_BY_DISCOUNT = ("katz_low", "katz_both", "katz_tri", "beta_bi", "beta_tri", "ds_bi", "ds_tri", "katz2", "joint", "pruned", "disc")
_BOOK = "(((r + 1) / r * (nr1 / nr) - 6 * n6 / n1) / (1 - 6 * n6 / n1))"


part(
    "disc",
    "hist",
    "SELECT n, r, CASE WHEN n1 > 0 AND n6 > 0 AND nr > 0 AND nr1 > 0 THEN least((r + 1) / r * (nr1 / nr) / (6 * n6 / n1), 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS d FROM (SELECT n, r, "
    "coalesce((SELECT types FROM hist h WHERE h.n = a.n AND h.r = 1), 0) AS n1, coalesce((SELECT types FROM hist h WHERE h.n = a.n AND h.r = 6), 0) AS n6, "
    "coalesce((SELECT types FROM hist h WHERE h.n = a.n AND h.r = b.r), 0) AS nr, coalesce((SELECT types FROM hist h WHERE h.n = a.n AND h.r = b.r + 1), 0) AS nr1 "
    "FROM (SELECT DISTINCT n FROM hist) a, (SELECT unnest(range(1, 6)) AS r) b)",
)
for _n, _g, _tot in ((2, "bi", "tot_bi"), (3, "tri", "tri_ctx")):
    part(f"ds_{_g}", f"{_g} {_tot} disc", f"SELECT g.ctx, g.w, g.count, coalesce(d, 1.0::DOUBLE) * g.count AS dc, total, coalesce(d, 1.0::DOUBLE) * g.count / total AS raw, total AS support FROM {_g} g JOIN {_tot} t ON t.ctx = g.ctx LEFT JOIN disc ON n = {_n} AND r = g.count")
part("katz2", "ds_bi", top("ds_bi"))
_BETA = "CASE WHEN abs((first(total) - sum(dc)) / first(total)) < 1e-12 THEN 0 ELSE (first(total) - sum(dc)) / first(total) / greatest(1 - sum(coalesce(%s, 0)), 1e-12) END AS beta"
part("beta_bi", "ds_bi mle", f"SELECT ctx, {_BETA % 'm.p'} FROM ds_bi LEFT JOIN mle m USING (w) GROUP BY ctx")
part("often", "mle", "SELECT * FROM mle ORDER BY count DESC, w LIMIT 10")
part(
    "katz_low",
    "beta_bi ds_bi often",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY raw DESC, w) AS rank FROM (SELECT ctx, w, raw FROM ds_bi UNION ALL SELECT ctx, o.w, beta * p FROM beta_bi b, often o WHERE beta > 0 AND NOT EXISTS (SELECT 1 FROM ds_bi s WHERE s.ctx = b.ctx AND s.w = o.w))) WHERE rank <= 10",
)
part("katz_both", "ds_tri katz_low", "SELECT s.*, split_part(s.ctx, ' ', 2) AS short, l.raw AS low FROM ds_tri s LEFT JOIN katz_low l ON l.ctx = split_part(s.ctx, ' ', 2) AND l.w = s.w")
part("beta_tri", "katz_both", f"SELECT ctx, {_BETA % 'low'} FROM katz_both GROUP BY ctx")
part(
    "katz_tri",
    "katz_both beta_tri katz_low",
    "SELECT ctx, w, raw, support FROM katz_both UNION ALL SELECT b.ctx, l.w, beta * l.raw, c.support FROM beta_tri b JOIN (SELECT DISTINCT ctx, short, support FROM katz_both) c USING (ctx) JOIN katz_low l ON l.ctx = c.short "
    "WHERE beta > 0 AND NOT EXISTS (SELECT 1 FROM katz_both s WHERE s.ctx = b.ctx AND s.w = l.w)",
)
part("joint", "ds_bi mle", "SELECT ctx || ' ' || d.w AS ctx, raw * p AS joint FROM ds_bi d JOIN mle m ON m.w = d.ctx")
part(
    "pruned",
    "katz_both beta_tri joint",
    "SELECT ctx, w, raw, support FROM (SELECT *, beta * coalesce(low, 0) AS bo FROM katz_both JOIN beta_tri USING (ctx) JOIN joint USING (ctx)) WHERE joint > 0 AND (bo <= 0 OR joint * raw * abs(ln(raw) - ln(greatest(bo, 1e-300))) > 1e-6)",
)
for _name in _BY_DISCOUNT:
    _needs, _sql = PARTS[_name]
    if _name == "disc":
        _sql = _sql.replace("(r + 1) / r * (nr1 / nr) / (6 * n6 / n1)", _BOOK)
    _renamed = re.compile(rf"\b({'|'.join(_BY_DISCOUNT)})\b")
    part(f"{_name}_tb", _renamed.sub(r"\1_tb", _needs), _renamed.sub(r"\1_tb", _sql))
part("pairs", "bi", "SELECT * FROM bi ORDER BY count DESC, ctx, w LIMIT 20000")
part("ratio", "pairs", "SELECT ctx, w, ln(count + 1) / ln(sum(count) OVER (PARTITION BY ctx) + 1) AS raw, sum(count) OVER (PARTITION BY ctx)::BIGINT AS support FROM pairs")
for _m in ("kn2", "katz2", "kn2_c"):
    part(f"top_{_m}", _m, f"SELECT ctx, max(CASE WHEN rank = 1 THEN w END) AS w, count(*) AS n, max(support) AS support, list(w ORDER BY rank) AS ws FROM {_m} GROUP BY ctx")
part("stop", "uni", "SELECT w FROM uni ORDER BY count DESC, w LIMIT 20")
part("cap", "uni", "SELECT w FROM uni ORDER BY count DESC, w LIMIT 1000")
part("common", "uni", "SELECT w FROM uni ORDER BY count DESC, w LIMIT 2000")
part("held", "kn2 cap", "SELECT *, w IN (SELECT w FROM cap) AS held FROM kn2")
part("quant", "kn2", "SELECT *, CASE WHEN hi = lo THEN 255 ELSE round_even((score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 255, 0)::INT END AS byte FROM kn2, (SELECT min(score) AS lo, max(score) AS hi FROM kn2)")
part("vocab", "uni", "SELECT row_number() OVER (ORDER BY w) - 1 AS word_id, w, round_even(count / (SELECT max(count) FROM uni) * 255, 0)::INT AS freq_byte FROM (SELECT * FROM uni ORDER BY count DESC, w LIMIT 65535)")
part("quant_log", "kn2", "SELECT *, CASE WHEN hi = lo THEN 255 ELSE round_even((log10(greatest(score, 0.0001)) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 255, 0)::INT END AS byte FROM kn2, (SELECT min(log10(greatest(score, 0.0001))) AS lo, max(log10(greatest(score, 0.0001))) AS hi FROM kn2)")
_WORDS = r"list_filter(regexp_split_to_array(%s, '\s+'), lambda x: x <> '')"
_RUNS = (
    "SELECT lower(array_to_string(t[i:i + n - 1], ' ')) AS phrase, min(item_id) AS at FROM (SELECT item_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM "
    f"(SELECT item_id, {_WORDS % 'text'} AS t FROM benchmark), (SELECT unnest(%s) AS n)) WHERE len(list_filter(t[i:i + n - 1], lambda w: NOT regexp_full_match(w, '[a-zA-Z'']+'))) = 0 GROUP BY 1"
)
part("phr", "", _RUNS % "[3, 4, 5]")
part("phr2", "", _RUNS % "[2]")
part("phr_n", "phr", f"SELECT phrase, count(*) AS count FROM (SELECT unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS phrase FROM (SELECT list_transform({_WORDS % 'line'}, lambda x: lower(x)) AS t FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)), (SELECT unnest([3, 4, 5]) AS n)) JOIN phr USING (phrase) GROUP BY phrase")
part(
    "cases",
    "",
    f"SELECT item_id, no::INT AS no, t[no - 2] AS w1, t[no - 1] AS w2, t[no] AS target, CASE WHEN (item_id + no) % 2 = 0 THEN substring(t[no], 1, 1) ELSE '' END AS prefix, item_id || ':' || no AS request_id FROM "
    f"(SELECT item_id, t, unnest(range(3, len(t) + 1)) AS no FROM (SELECT item_id, list_transform({_WORDS % 'text'}, lambda x: lower(x)) AS t FROM benchmark)) WHERE regexp_full_match(t[no], '[a-z'']+')",
)
_NEXT = "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS place, w, support FROM cases JOIN %s m ON m.ctx = %s AND starts_with(m.w, lower(prefix)) QUALIFY place <= 5"
part("answers", "cases kn2 kn3", f"SELECT *, 0 AS tier FROM ({_NEXT % ('kn3', chr(39).join(['w1 || ', ' ', ' || w2']))}) UNION ALL SELECT *, 1 FROM ({_NEXT % ('kn2', 'w2')})")
part(
    "casc",
    "answers cases",
    "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN tiers = 1 THEN 0 ELSE -votes END, seat.tier, seat.place) AS place, w FROM (SELECT request_id, w, sum(support * (many - place + 1)) AS votes, max(tiers) AS tiers, "
    "min({'tier': tier, 'place': place}) AS seat FROM (SELECT *, count(*) OVER (PARTITION BY request_id, tier) AS many FROM answers) JOIN (SELECT request_id, count(DISTINCT tier) AS tiers FROM answers GROUP BY 1) USING (request_id) GROUP BY 1, 2) "
    "JOIN (SELECT request_id, w1, w2 FROM cases) USING (request_id) WHERE tiers = 1 OR (w <> w1 AND w <> w2) QUALIFY place <= 5",
)
part("typed", "cases", "SELECT DISTINCT target FROM cases")
part("steps", "", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, prev, w FROM (SELECT *, event_type AS w, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type <> '') WHERE prev IS NOT NULL")
part("moves", "steps", "SELECT user_id, prev, w, count(*) AS uses, sum(gain) AS dee, max(tick) AS last_tick FROM (SELECT *, coalesce(exp((lag(tick) OVER (PARTITION BY user_id, prev, w ORDER BY tick) - tick) / 200.0::DOUBLE), 1) AS gain FROM steps) GROUP BY 1, 2, 3")

part("stop_raw", "tot_bi mle stop", f"SELECT ctx, w, raw * CASE WHEN w IN (SELECT w FROM stop) THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS raw, support FROM (SELECT b.ctx, b.w, {_KN.replace('count', 'b.count') % 'coalesce(p, 0)'}, total AS support FROM bi b JOIN tot_bi USING (ctx) LEFT JOIN mle USING (w))")
_BYTE_LOG = "CASE WHEN hi = lo THEN 255 ELSE round_even((log10(greatest(score, 0.0001)) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 255, 0)::INT END"
part("quant3", "kn3", f"SELECT *, {_BYTE_LOG} AS byte FROM kn3, (SELECT min(log10(greatest(score, 0.0001))) AS lo, max(log10(greatest(score, 0.0001))) AS hi FROM kn3)")
part("vocab_cap", "cap", "SELECT row_number() OVER (ORDER BY w) - 1 AS word_id, w FROM cap")
part("root", "uni", "SELECT row_number() OVER (ORDER BY count DESC, w) AS rank, w, count / max(count) OVER () AS score, sum(count) OVER ()::BIGINT AS support FROM (SELECT * FROM uni ORDER BY count DESC, w LIMIT 255)")
part("prefixes", "uni", "SELECT prefix, max(count) AS most FROM (SELECT count, unnest(list_transform(range(1, length(w) + 1), lambda k: substring(w, 1, k))) AS prefix FROM uni) GROUP BY prefix")
_UNDER = "SELECT target AS query, row_number() OVER (PARTITION BY target ORDER BY count DESC, w) AS place, w FROM typed JOIN %s ON starts_with(w, target) QUALIFY place <= 5"
part("exact", "typed uni uni_c", f"SELECT query, row_number() OVER (PARTITION BY query ORDER BY seat.source, seat.place) AS place, w FROM (SELECT query, w, min({{'source': source, 'place': place}}) AS seat FROM (SELECT *, 0 AS source FROM ({_UNDER % 'uni_c'}) UNION ALL SELECT *, 1 FROM ({_UNDER % 'uni'})) GROUP BY 1, 2) QUALIFY place <= 5")
part("either", "uni uni_c", "SELECT w, coalesce(c.count, u.count) AS count FROM uni u FULL JOIN uni_c c USING (w)")
part("near", "typed either", "SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, common DESC, count DESC, w) AS place, w FROM (SELECT target AS query, w, count, levenshtein(target, w) AS distance, len(list_filter(range(1, len(target) + 1), lambda k: substring(target, 1, k) = substring(w, 1, k))) AS common FROM typed JOIN either ON abs(len(target) - len(w)) <= 2 AND len(target) > 3 AND levenshtein(target, w) <= CASE WHEN len(target) = 4 THEN 1 ELSE 2 END) QUALIFY place <= 5")
part("merged", "exact near", "SELECT query, row_number() OVER (PARTITION BY query ORDER BY source, place) AS place, w FROM (SELECT query, place, w, 0 AS source FROM exact UNION ALL SELECT n.query, n.place, n.w, 1 FROM near n LEFT JOIN (SELECT query, count(*) AS had FROM exact GROUP BY 1) h USING (query) WHERE n.place <= 5 - coalesce(had, 0) AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.query = n.query AND e.w = n.w)) QUALIFY place <= 5")

ORACLES: dict[str, str] = {
    "unigram_counts": sql("uni", "SELECT * FROM uni"),
    "bigram_counts": sql("bi", "SELECT * FROM bi"),
    "trigram_counts": sql("tri", "SELECT * FROM tri"),
    "count_of_counts": sql("hist", "SELECT * FROM hist"),
    "context_totals": sql("tot_bi", "SELECT * FROM tot_bi"),
    "continuation_prob": sql("cont_bi", "SELECT * FROM cont_bi"),
    "unigram_mle": sql("mle", "SELECT * FROM mle"),
    "kn_bigram_topk": sql("kn2", "SELECT * FROM kn2"),
    "kn_trigram_topk": sql("kn3", "SELECT * FROM kn3"),
    "kn_order4": sql("kn_o4", top("kn_o4")),
    "katz_discounts": sql("disc", "SELECT n, r, round(d, 6) AS d FROM disc"),
    "katz_bigram_topk": sql("katz2", "SELECT * FROM katz2"),
    "katz_trigram_topk": sql("katz_tri", top("katz_tri")),
    "pruned_trigram_topk": sql("pruned", top("pruned")),
    "log_ratio_topk": sql("ratio", top("ratio")),
    "stop_word_rescore": sql("kn2 stop", "SELECT ctx, row_number() OVER (PARTITION BY ctx ORDER BY s DESC, rank) AS rank, w, round(s, 5) AS score, support FROM (SELECT *, CASE WHEN w IN (SELECT w FROM stop) THEN score * 0.5 ELSE score END AS s FROM kn2)"),
    "word_scores": sql("uni", "SELECT w, greatest(1, round(count / (SELECT max(count) FROM uni) * 1000000, 0))::BIGINT AS score FROM uni"),
    "compare_sweep": sql("top_kn2 top_katz2", "SELECT threshold, count(*) AS contexts, count(*) FILTER (a.w = b.w) AS agree FROM top_kn2 a JOIN top_katz2 b USING (ctx) JOIN (SELECT unnest([3, 5, 10, 25, 50]) AS threshold) ON a.support >= threshold GROUP BY threshold"),
    "compare_identical": sql("top_kn2 top_katz2", "SELECT count(*) AS contexts, count(*) FILTER (a.ws = b.ws) AS identical, count(*) FILTER (a.w = b.w) AS agree FROM top_kn2 a JOIN top_katz2 b USING (ctx)"),
    "compare_three_way": sql("top_kn2 top_katz2 top_kn2_c", "SELECT a.n IS NOT NULL AS in_a, b.n IS NOT NULL AS in_b, c.n IS NOT NULL AS in_c, count(*) AS contexts, coalesce(sum(a.n), 0)::BIGINT AS followers_a, coalesce(sum(b.n), 0)::BIGINT AS followers_b, coalesce(sum(c.n), 0)::BIGINT AS followers_c FROM top_kn2 a FULL JOIN top_katz2 b USING (ctx) FULL JOIN top_kn2_c c USING (ctx) GROUP BY 1, 2, 3"),
    "dropped_contexts": sql("top_kn2 top_kn2_c", "SELECT ctx, w AS top, support FROM top_kn2 WHERE ctx NOT IN (SELECT ctx FROM top_kn2_c)"),
    "top_disagreements": sql("top_kn2 top_katz2", "SELECT ctx, a.w AS top_a, b.w AS top_b, a.support FROM top_kn2 a JOIN top_katz2 b USING (ctx) WHERE a.w <> b.w ORDER BY a.support DESC, ctx LIMIT 20"),
    "follower_stats": sql("top_kn2", "SELECT count(*) AS contexts, sum(n)::BIGINT AS followers, min(n) AS fewest, max(n) AS most, round(avg(n), 6) AS mean, count(*) FILTER (n = 10) AS \"full\" FROM top_kn2"),
    "vocab_cap": sql("held", "SELECT * FROM (SELECT count(*) AS contexts, count(*) FILTER (kept = 0) AS emptied, sum(n)::BIGINT AS followers, sum(n - kept)::BIGINT AS dropped, count(*) FILTER (top) AS agree FROM (SELECT ctx, count(*) AS n, count(*) FILTER (held) AS kept, bool_or(held AND rank = 1) AS top FROM held GROUP BY ctx)), (SELECT count(DISTINCT w) AS distinct_words, count(DISTINCT w) FILTER (NOT held) AS distinct_outside FROM held)"),
    "vocab_capped_model": sql("held", "SELECT ctx, row_number() OVER (PARTITION BY ctx ORDER BY rank) AS rank, w, score, support FROM held WHERE held"),
    "quantized_scores": sql("quant", "SELECT ctx, rank, w, byte FROM quant"),
    "quantization_flips": sql("quant", "SELECT count(*) AS neighbours, count(*) FILTER (nb > byte) AS flips, count(*) FILTER (nb = byte AND ns < score) AS ties FROM (SELECT *, lead(byte) OVER (PARTITION BY ctx ORDER BY rank) AS nb, lead(score) OVER (PARTITION BY ctx ORDER BY rank) AS ns FROM quant) WHERE nb IS NOT NULL"),
    "pack_vocabulary": sql("vocab", "SELECT * FROM vocab"),
    "pack_followers": sql("quant_log vocab", "SELECT c.word_id AS ctx_id, row_number() OVER (PARTITION BY c.word_id ORDER BY rank) - 1 AS pos, v.word_id, byte FROM quant_log q JOIN vocab v ON v.w = q.w JOIN vocab c ON c.w = q.ctx"),
    "clean_line_reasons": sql("", rf"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(line, '[A-Z][a-zA-Z'' ]{{0,20}}:\s*') THEN 'label' WHEN len({_WORDS % "regexp_replace(line, '^-' || chr(92) || 's*', '')"}) < 3 THEN 'short' ELSE 'kept' END AS reason FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents) WHERE line <> '') GROUP BY reason"),
    "sentence_split": sql("", r"SELECT item_id, (no - 1)::INT AS no, list[no] AS sentence FROM (SELECT item_id, list, unnest(range(1, len(list) + 1)) AS no FROM (SELECT item_id, string_split(regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’—–…“”', '''''   '), '\s+', ' ', 'g'), '^ | $', '', 'g'), '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS list FROM benchmark)) WHERE len(string_split(list[no], ' ')) >= 6"),
    "phrase_candidates": sql("phr", "SELECT * FROM phr"),
    "phrase_counts": sql("phr_n", "SELECT * FROM phr_n"),
    "phrase_all_common": sql("phr common", "SELECT * FROM phr WHERE phrase NOT IN (SELECT phrase FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS w FROM phr) WHERE w NOT IN (SELECT w FROM common))"),
    "eval_cases": sql("cases", "SELECT * EXCLUDE (request_id) FROM cases"),
    "next_words": sql("cases kn2", _NEXT % ("kn2", "w2")),
    "support_lookup": sql("cases kn2", "SELECT request_id, coalesce(support, 0) AS support FROM cases LEFT JOIN (SELECT ctx, max(support) AS support FROM kn2 GROUP BY ctx) m ON m.ctx = w2"),
    "cascade": sql("casc", "SELECT * FROM casc"),
    "eval_pass_rate": sql("casc cases", "SELECT typed, count(*) AS cases, count(hit) AS passed FROM (SELECT prefix <> '' AS typed, a.w AS hit FROM cases c LEFT JOIN casc a ON a.request_id = c.request_id AND a.w = c.target) GROUP BY ROLLUP (typed)"),
    "prefix_completion": sql("typed uni", "SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY count DESC, w) AS place, w FROM (SELECT DISTINCT substring(target, 1, 3) AS prefix FROM typed) JOIN uni ON starts_with(w, prefix) QUALIFY place <= 5"),
    "fuzzy_matches": sql("typed uni", "SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, common DESC, count DESC, w) AS place, w, distance::INT AS distance FROM (SELECT target AS query, w, count, levenshtein(target, w) AS distance, len(list_filter(range(1, len(target) + 1), lambda k: substring(target, 1, k) = substring(w, 1, k))) AS common FROM typed JOIN uni ON abs(len(target) - len(w)) <= 2 AND levenshtein(target, w) <= CASE WHEN len(target) <= 3 THEN 0 WHEN len(target) = 4 THEN 1 ELSE 2 END) QUALIFY place <= 5"),
    "user_transitions": sql("moves", "SELECT user_id, prev, w, uses, round(dee, 6) AS dee, last_tick FROM moves"),
    "user_scores": sql("moves", "SELECT user_id, prev, w, round(CASE WHEN dee < 20 THEN m + (0.5 - m) * (dee / km) ELSE m + (1 - m) * (pow(4, dee / km) - 1) / 3 END, 6) AS score FROM (SELECT *, 1 / (1 - exp(-0.005)) AS km, 1 - 0.95 * pow(1 - exp(-ticks / 10000.0::DOUBLE), 10) AS m FROM moves JOIN (SELECT user_id, count(*) AS ticks FROM steps GROUP BY 1) USING (user_id))"),
    "word_decay": sql("", "SELECT user_id, event_type AS w, floor(count(*) * pow(0.9, 7))::BIGINT AS frequency FROM events GROUP BY 1, 2 HAVING floor(count(*) * pow(0.9, 7)) > 0"),
    "double_events": sql("", "SELECT user_id, event_id, event_type, gap_us FROM (SELECT *, lag(event_type) OVER o AS before, epoch_us(ts) - epoch_us(lag(ts) OVER o) AS gap_us FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before = event_type AND gap_us >= 0 AND gap_us < 3600000000"),
    "event_metrics": sql("", "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean FROM events GROUP BY event_type"),
    "stream_word_frequencies": sql("", "SELECT user_id, event_type AS w, count(*) AS frequency FROM events GROUP BY 1, 2"),
    "katz_textbook_discounts": sql("disc_tb", "SELECT n, r, round(d, 6) AS d FROM disc_tb"),
    "katz_textbook_bigram_topk": sql("katz2_tb", "SELECT * FROM katz2_tb"),
    "katz_textbook_trigram_topk": sql("katz_tri_tb", top("katz_tri_tb")),
    "pruned_textbook_topk": sql("pruned_tb", top("pruned_tb")),
    "stop_discount_topk": sql("stop_raw", top("stop_raw")),
    "pack_trigrams": sql("quant3 vocab_cap", "SELECT a.word_id AS ctx_id1, b.word_id AS ctx_id2, row_number() OVER (PARTITION BY a.word_id, b.word_id ORDER BY rank) - 1 AS pos, v.word_id, byte FROM quant3 q JOIN vocab_cap v ON v.w = q.w JOIN vocab_cap a ON a.w = split_part(q.ctx, ' ', 1) JOIN vocab_cap b ON b.w = split_part(q.ctx, ' ', 2)"),
    "pack_root": sql("root", f"SELECT rank, w, support, {_BYTE_LOG} AS byte FROM root, (SELECT min(log10(greatest(score, 0.0001))) AS lo, max(log10(greatest(score, 0.0001))) AS hi FROM root)"),
    "vocabulary_union": sql("uni kn2 kn2_c", "SELECT w, max(count)::BIGINT AS count FROM (SELECT w, count FROM uni UNION ALL SELECT ctx, 0 FROM kn2 UNION ALL SELECT w, 0 FROM kn2 UNION ALL SELECT ctx, 0 FROM kn2_c UNION ALL SELECT w, 0 FROM kn2_c) GROUP BY w"),
    "dequantized_scores": sql("quant_log", "SELECT ctx, rank, round(CASE WHEN hi = lo THEN 1 ELSE pow(10, lo + byte / 255 * (hi - lo)) END, 6) AS score FROM quant_log"),
    "cap_agreement": sql("quant_log", "SELECT cap, count(*) AS contexts, count(*) FILTER (a[:cap] <> b[:cap]) AS flips, count(*) FILTER (tie) AS ties FROM (SELECT ctx, list(w ORDER BY rank) AS a, list(w ORDER BY byte DESC, rank) AS b, count(*) > count(DISTINCT byte) AS tie FROM quant_log GROUP BY ctx), (SELECT unnest([1, 3, 5, 10]) AS cap) GROUP BY cap"),
    "model_size": sql("kn2", r"""SELECT threshold, count(*) AS contexts, sum(size)::BIGINT + count(*) + 1 AS bytes FROM (SELECT strlen('"' || ctx || '":{"followers":[' || string_agg('["' || w || '",' || regexp_replace(regexp_replace(score::DECIMAL(6, 4)::VARCHAR, '0+$', ''), '\.$', '.0') || ']', ',') || '],"support":' || max(support) || '}') AS size, max(support) AS support FROM kn2 GROUP BY ctx) JOIN (SELECT unnest([3, 5, 10, 25, 50]) AS threshold) ON support >= threshold GROUP BY threshold"""),
    "word_ranks": sql("uni", "SELECT w, row_number() OVER (ORDER BY count DESC, w) AS rank FROM uni"),
    "target_words": sql("typed uni stop", "SELECT target FROM typed JOIN (SELECT w, row_number() OVER (ORDER BY count DESC, w) AS rank FROM uni) ON w = target WHERE rank > 200 AND length(target) >= 3 AND target NOT IN (SELECT w FROM stop)"),
    "unigram_dedup": sql("", f"SELECT lower(w) AS w, max(count) AS count FROM (SELECT w, count(*) AS count FROM (SELECT unnest({_WORDS % 'line'}) AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE regexp_full_match(w, '[A-Za-z'']+') GROUP BY w) GROUP BY 1"),
    "bigram_aware": sql("cases kn2 uni", f"SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY seat.source, seat.place) AS place, w FROM (SELECT request_id, w, min({{'source': source, 'place': place}}) AS seat FROM (SELECT request_id, 0 AS source, place, w FROM ({_NEXT % ('kn2', 'w2')}) UNION ALL SELECT request_id, 1, place, w FROM cases JOIN (SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY count DESC, w) AS place, w FROM (SELECT DISTINCT prefix FROM cases WHERE prefix <> '') JOIN uni ON starts_with(w, prefix) QUALIFY place <= 10) USING (prefix)) WHERE request_id IN (SELECT request_id FROM cases WHERE prefix <> '') GROUP BY ALL) QUALIFY place <= 5"),
    "merged_suggestions": sql("merged", "SELECT * FROM merged"),
    "display_slots": sql("merged", "SELECT query, (row_number() OVER (PARTITION BY query ORDER BY place) - 1)::INT AS slot, w FROM (SELECT DISTINCT query, 0 AS place, query AS w FROM merged UNION ALL SELECT query, place, w FROM merged WHERE w <> query) QUALIFY slot < 3"),
    "user_blend": sql("moves steps", "WITH pack AS (SELECT prev, w, n / max(n) OVER (PARTITION BY prev) AS score FROM (SELECT prev, w, count(*) AS n FROM steps GROUP BY 1, 2)), own AS (SELECT user_id || ':' || prev AS key, prev, w, dee, CASE WHEN dee < 20 THEN m + (0.5 - m) * (dee / km) ELSE m + (1 - m) * (pow(4, dee / km) - 1) / 3 END AS score FROM (SELECT *, 1 / (1 - exp(-0.005)) AS km, 1 - 0.95 * pow(1 - exp(-ticks / 10000.0::DOUBLE), 10) AS m FROM moves JOIN (SELECT user_id, count(*) AS ticks FROM steps GROUP BY 1) USING (user_id))), parts AS (SELECT key, w, 0.7::DOUBLE * score AS part FROM (SELECT key, p.w, p.score FROM (SELECT DISTINCT key, prev FROM own) JOIN pack p USING (prev) QUALIFY row_number() OVER (PARTITION BY key ORDER BY p.score DESC, p.w) <= 10) UNION ALL SELECT key, w, 0.3::DOUBLE * score FROM (SELECT * FROM own WHERE dee >= 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, w) <= 10)) SELECT key, row_number() OVER (PARTITION BY key ORDER BY s DESC, w) AS place, w, round(s, 6) AS score FROM (SELECT key, w, sum(part) AS s FROM parts GROUP BY 1, 2) QUALIFY place <= 5").replace(" WITH pack AS", ", pack AS", 1),
    "word_membership": sql("typed uni", "SELECT target, target IN (SELECT w FROM uni) AS known FROM typed"),
    "first_completions": sql("typed uni", "SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY w) AS place, w FROM (SELECT DISTINCT substring(target, 1, 3) AS prefix FROM typed) JOIN uni ON starts_with(w, prefix) AND w <> prefix QUALIFY place <= 3"),
    "snippet_matches": sql("", "SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY code) AS place, code, expansion FROM (SELECT lower(n_name) AS code, n_name || ' ' || n_regionkey AS expansion FROM nation) JOIN (SELECT unnest(['', 'n', 'nation_1', 'nation_2', 'x']) AS prefix) ON starts_with(code, prefix) WHERE regexp_full_match(code, '[a-z0-9_]+') AND expansion <> '' QUALIFY place <= 3"),
    "text_ends": sql("", rf"SELECT item_id, regexp_extract(right(text, 50), '[\p{{L}}\p{{N}}'']+$') AS fragment, coalesce(lower({_WORDS % "left(text, length(text) - length(string_split(text, ' ')[-1]))"}[-1]), '') AS ctx, string_split(text, ' ')[-1] AS prefix FROM benchmark"),
    "genre_sample": sql("", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) <= 5"),
    "phrase_attach": sql("phr2 common kn3", "SELECT phrase, CASE WHEN split_part(phrase, ' ', 1) NOT IN (SELECT w FROM common) OR split_part(phrase, ' ', 2) NOT IN (SELECT w FROM common) THEN 'oov' WHEN phrase IN (SELECT ctx FROM kn3) THEN 'attached' ELSE 'no_path' END AS status FROM phr2"),
    "phrase_extensions": sql("phr_n cases", "SELECT ctx, phrase, count FROM (SELECT phrase, count, array_to_string(string_split(phrase, ' ')[:k], ' ') AS ctx FROM (SELECT phrase, count, unnest(range(greatest(1, len(string_split(phrase, ' ')) - 3), len(string_split(phrase, ' ')) + 1)) AS k FROM phr_n)) JOIN (SELECT w2 AS ctx FROM cases UNION SELECT w1 || ' ' || w2 FROM cases) USING (ctx)"),
    "learned_words": sql("uni", f"SELECT w, count(*) AS frequency FROM (SELECT item_id, t[no + 1] AS w, no FROM (SELECT item_id, t, unnest(range(0, len(t))) AS no FROM (SELECT item_id, {_WORDS % 'text'} AS t FROM benchmark))) WHERE length(w) > 1 AND NOT starts_with(w, ';') AND ((item_id + no) % 2 <> 0 OR w IN (SELECT w FROM uni)) GROUP BY w"),
    "recorded_transitions": sql("moves", "SELECT user_id, prev, w, round(dee, 6) AS dee, last_tick FROM moves"),
    "daily_decay": sql("", "SELECT user_id, w, frequency FROM (SELECT user_id, event_type AS w, floor(count(*) * pow(0.9, date_diff('day', max(ts)::DATE, (SELECT max(ts) FROM events)::DATE)))::BIGINT AS frequency FROM events GROUP BY 1, 2) WHERE frequency > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY frequency DESC, w) <= 5000"),
    "pruned_dictionary": sql("uni prefixes", "SELECT w, count FROM (SELECT *, row_number() OVER (ORDER BY count DESC, w) AS place FROM uni) WHERE place <= 5000 OR (SELECT count(*) + 1 FROM prefixes) <= 50000"),
    "prefix_maxima": sql("prefixes", "SELECT * FROM prefixes"),
    "event_percentiles": sql("", "SELECT event_type, v[floor(n * 0.5::DOUBLE)::BIGINT + 1] AS p50, v[floor(n * 0.99::DOUBLE)::BIGINT + 1] AS p99 FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"),
    "two_before": sql("", "SELECT user_id, event_id, lag(event_type, 2) OVER o AS w1, lag(event_type, 1) OVER o AS w2 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)"),
}
