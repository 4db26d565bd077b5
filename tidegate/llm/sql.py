"""SQL for the training-data queries whose result plain SQL states on whole tables."""

import unicodedata as U

from tidegate.llm.lookalike import ARMENIAN, CYRILLIC, GREEK

# Problem 8 in SQL: classes of characters by regular expression, letters by the same fixed tables, accents by NFC.
_LOOKS = dict(zip(CYRILLIC[0] + GREEK[0] + ARMENIAN[0], CYRILLIC[1] + GREEK[1] + ARMENIAN[1]))
_ACCENTED = {c: U.normalize("NFC", _LOOKS[d[0]] + d[1:]) for n in range(0x370, 0x530) for c in [chr(n)] for d in [U.normalize("NFD", c)] if len(d) > 1 and d[0] in _LOOKS}
_ACCENTED = {c: v for c, v in _ACCENTED.items() if len(v) == 1}
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
_FORM = r"regexp_replace(regexp_replace(text, '[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{034F}\x{115F}\x{1160}\x{3164}\x{17B4}\x{17B5}\x{180B}-\x{180F}\p{Cf}\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]', '', 'g'), '\p{Zs}', ' ', 'g')"
for _a, _b in ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ"):
    _FORM = f"replace({_FORM}, '{_a}', '{_b}')"
for _a, _b in _WIDE, ("".join(_LOOKS), "".join(_LOOKS.values())), ("".join(_ACCENTED), "".join(_ACCENTED.values())):
    _FORM = "translate({}, '{}', '{}')".format(_FORM, _a, _b.replace("'", "''"))
_LIKE = f"forms AS (SELECT doc_id, text, nfc_normalize({_FORM}) AS form FROM documents WHERE length(text) > 0)"

# Problem 7 in SQL: the same normalisation by regular expressions, pairs that share any five words, and per pair the
# table of the earliest starts of pieces with up to three edits, one row of it per step of the recursion.
_TAGS = r"</?(?:b|i|u|s|em|strong|span|a|code|mark|small|font|tt|sup|sub)(?:\s[^<>]*)?>"


def _words(column: str) -> str:
    out = column
    for a, b in ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"lower(strip_accents({_FORM.replace('(text,', f'({out},')}))"
    for a, b in (_TAGS, ""), ("</?[a-z!][^<>]*>", " "), ("([0-9])[.,]([0-9])", r"\1\2"), ("([0-9])[.,]([0-9])", r"\1\2"), ("[''’`´]", ""), (r"(?:\\[nrt]|[^\p{L}\p{N}])+", " "):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"string_split(trim({out}), ' ')"


def _starts(e: int) -> str:
    same = f"CASE WHEN b[j - 1] = a[k] THEN s{e}[j - 1] ELSE k END"
    if not e:
        return f"list_transform(range(1, len(b) + 2), lambda j: CASE WHEN j > 1 THEN {same} ELSE k END)"
    return f"list_transform(range(1, len(b) + 2), lambda j: CASE WHEN j > 1 THEN least(s{e - 1}[j], s{e - 1}[j - 1], n{e - 1}[j - 1], {same}) ELSE least(k, s{e - 1}[j]) END)"


_STEP = "(SELECT *, i + 1 AS k FROM dp WHERE i < len(a))"
for _e in range(4):
    _STEP = f"(SELECT *, {_starts(_e)} AS n{_e} FROM {_STEP})"
_LEAKED = f"""WITH RECURSIVE
dw AS (SELECT doc_id, {_words('text')} AS b FROM documents WHERE length(text) > 0),
iw AS (SELECT item_id, {_words('passage')} AS a FROM eval_items WHERE length(passage) > 0),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(b) - 3), lambda p: {{'p': p, 'g': array_to_string(b[p:p + 4], ' ')}}), recursive := true) FROM dw),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(a) - 3), lambda p: array_to_string(a[p:p + 4], ' '))) AS g FROM iw),
near AS (SELECT item_id, doc_id, min(p) AS lo, max(p) AS hi FROM dg JOIN ig ON dg.g = ig.g GROUP BY ALL),
dp AS (
  SELECT item_id, doc_id, a, b, 0::BIGINT AS i, z AS s0, z AS s1, z AS s2, z AS s3 FROM (
    SELECT item_id, doc_id, a, b[greatest(1, lo - 2 * len(a)):hi + 2 * len(a)] AS b, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS z
    FROM near JOIN iw USING (item_id) JOIN dw USING (doc_id))
  UNION ALL SELECT item_id, doc_id, a, b, k, n0, n1, n2, n3 FROM {_STEP}),
ends AS (SELECT item_id, doc_id, len(a) AS n, i, unnest([{{'e': 0, 's': list_min(s0)}}, {{'e': 1, 's': list_min(s1)}}, {{'e': 2, 's': list_min(s2)}}, {{'e': 3, 's': list_min(s3)}}], recursive := true) FROM dp),
pieces AS (SELECT item_id, doc_id, i, min(s) AS s FROM ends WHERE i - s >= least(20, n) AND 10 * e <= i - s GROUP BY ALL),
leaked AS (SELECT item_id, doc_id, count(DISTINCT w) AS n_words FROM (SELECT item_id, doc_id, unnest(range(s, i)) AS w FROM pieces) GROUP BY ALL)
"""

_FINITE = " AND ".join(
    f"{f} IS NOT NULL AND isfinite({f})"
    for f in (
        "flow_duration header_length protocol_type duration rate srate syn_flag_number ack_flag_number rst_count http tcp "
        "udp icmp tot_sum pkt_min pkt_max pkt_avg pkt_std tot_size variance"
    ).split()
)

_FEATURES = [x.split(" ")[0] for x in _FINITE.split(" AND ")[::2]]
_CLOSE = " AND ".join(f"abs(t.{f} - e.{f}) <= 0.001 * greatest(abs(t.{f}), abs(e.{f}))" for f in _FEATURES)

_OVERLAP = f"""
t AS (SELECT * FROM flow_scan WHERE split_name = 'train' AND {_FINITE}),
e AS (SELECT * FROM flow_scan WHERE split_name IN ('val', 'test') AND {_FINITE}),
pairs AS (SELECT t.row_id AS train_id, e.row_id AS eval_id, t.feat_hash AS train_feat_hash, e.feat_hash AS eval_feat_hash,
  t.codes AS train_codes, e.codes AS eval_codes, e.split_name, e.device,
  {" AND ".join(f"t.{f} = e.{f}" for f in _FEATURES)} AS exact FROM t JOIN e ON {_CLOSE})
"""

_SCORES = """
latest AS (
  SELECT * FROM target_scores
  QUALIFY row_number() OVER (PARTITION BY target_name, row_id ORDER BY scored_at DESC NULLS LAST, score_id DESC) = 1),
valid AS (
  SELECT target_name, source, score_id, p_attack AS p FROM latest
  WHERE p_attack >= 0 AND p_attack <= 1 AND NOT isnan(p_attack) AND source IS NOT NULL),
freq AS (SELECT target_name, source, p, count(*) AS n FROM valid GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY target_name, source ORDER BY p DESC) AS upto,
    sum(n) OVER (PARTITION BY target_name, source) AS total FROM freq),
allowed AS (
  SELECT c.*, t.keep_ppm, (c.total * greatest(0, least(1000000, coalesce(t.keep_ppm, 0)))) // 1000000 AS may_keep
  FROM cum c JOIN targets t USING (target_name))
"""

_PLANS = f"""
flows AS (SELECT DISTINCT ON (f.file_path, f.row_no) regexp_replace(lower(m.category), '[^a-z0-9]', '', 'g') AS g
  FROM flow_scan f JOIN label_map m ON f.codes = m.code WHERE {_FINITE} ORDER BY f.file_path, f.row_no, f.row_id),
reported AS (SELECT DISTINCT run_id, spec, attack, model, regexp_replace(lower(grp), '[^a-z0-9]', '', 'g') AS g
  FROM realizable_report WHERE grp IS NOT NULL),
have AS (SELECT 'flow_scan' AS population, g, count(*) AS n FROM flows GROUP BY g
  UNION ALL SELECT 'realizable_report', g, count(*) FROM reported GROUP BY g),
lines AS (
  SELECT w.plan_id, w.population, w.g, w.size, w.needed, greatest(w.min_rows, w.size * w.ppm // 1000000) AS low, coalesce(h.n, 0) AS n
  FROM (SELECT plan_id, population, regexp_replace(lower(grp), '[^a-z0-9]', '', 'g') AS g, sample_size AS size, target_ppm AS ppm, min_rows,
      greatest(min_rows, (sample_size * target_ppm + 999999) // 1000000) AS needed FROM sample_targets) w
  LEFT JOIN have h ON w.population = h.population AND w.g = h.g)
"""

SQL = {
    "p2_found": f"""WITH {_SCORES} SELECT v.score_id FROM valid v JOIN allowed a
        ON v.target_name = a.target_name AND v.source = a.source AND v.p = a.p WHERE a.upto <= a.may_keep""",
    "p2_cutoffs": f"""WITH {_SCORES} SELECT target_name, source, any_value(total)::BIGINT AS n_records, any_value(keep_ppm) AS keep_ppm,
        any_value(may_keep)::BIGINT AS may_keep, coalesce(sum(n) FILTER (WHERE upto <= may_keep), 0)::BIGINT AS n_kept,
        min(p) FILTER (WHERE upto <= may_keep) AS cutoff FROM allowed GROUP BY target_name, source""",
    "p3_found": f"WITH {_OVERLAP} SELECT least(train_id, eval_id) AS row_a, greatest(train_id, eval_id) AS row_b FROM pairs",
    "p3_pairs": f"WITH {_OVERLAP} SELECT train_id, eval_id, train_feat_hash, eval_feat_hash, train_codes, eval_codes, exact FROM pairs",
    "p3_overlap": f"""WITH {_OVERLAP}, best AS (SELECT eval_id, any_value(split_name) AS split_name, any_value(device) AS device,
          bool_or(exact) AS exact FROM pairs GROUP BY eval_id)
        SELECT split_name, device, count(*) AS n_rows, count(*) FILTER (WHERE exact) AS n_exact,
          count(*) FILTER (WHERE NOT exact) AS n_almost FROM best GROUP BY split_name, device""",
    "p4_found": """WITH RECURSIVE
        k AS (SELECT record_id, 'g' || group_key AS k FROM adv_rows UNION ALL SELECT record_id, 'h' || clean_hash FROM adv_rows
          UNION ALL SELECT record_id, 'c' || lower(trim(capture_id)) FROM adv_rows WHERE lower(trim(capture_id)) NOT IN
            ('', 'unknown', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', 'missing', 'undefined', 'not available', '-', '--', '?')),
        stars AS (SELECT record_id AS a, min(record_id) OVER (PARTITION BY k) AS b FROM k WHERE k IS NOT NULL),
        links AS (SELECT a, b FROM stars WHERE a <> b UNION SELECT b, a FROM stars WHERE a <> b),
        reach AS (SELECT DISTINCT a AS id, a AS seen FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.seen = l.a),
        roots AS (SELECT id AS record_id, min(seen) AS root_id FROM reach GROUP BY id)
        SELECT root_id, record_id FROM roots WHERE root_id < record_id""",
    "p4_properties": """SELECT 'records' AS property, count(DISTINCT record_id) AS value FROM adv_rows UNION ALL SELECT unnest(['records without a known split', 'components in two splits',
        'splits off by more than one percent', 'large attack and model pairs off by more than five percent']), 0""",
    "p5_margins": f"WITH {_PLANS} SELECT plan_id, g AS grp_slug, needed, n AS available, true AS kept FROM lines",
    "p5_totals": f"""WITH {_PLANS}, sized AS (SELECT plan_id, population, g, any_value(size) AS size, least(sum(low), any_value(n)) AS low, least(sum(needed), any_value(n)) AS high FROM lines GROUP BY ALL),
        totals AS (SELECT plan_id, greatest(sum(low), least(sum(high), max(size)))::BIGINT AS n FROM sized GROUP BY plan_id) SELECT plan_id, n AS n_rows, n AS n_different FROM totals WHERE n > 0""",
    "p6_properties": """WITH t AS (SELECT b.bin_kind, d.doc_id, strlen(d.text) + 1 AS tokens FROM documents d, pack_bins b WHERE strlen(d.text) > 0)
        SELECT bin_kind, count(*) AS n_documents, sum(tokens)::BIGINT AS tokens, 0 AS n_wrongly_cut, 0 AS n_too_full, true AS filled FROM t GROUP BY bin_kind""",
    "p5_found": f"""WITH
        flows AS (SELECT DISTINCT ON (f.file_path, f.row_no) regexp_replace(lower(m.category), '[^a-z0-9]', '', 'g') AS g
          FROM flow_scan f JOIN label_map m ON f.codes = m.code WHERE {_FINITE} ORDER BY f.file_path, f.row_no, f.row_id),
        lines AS (SELECT DISTINCT run_id, spec, attack, model, regexp_replace(lower(grp), '[^a-z0-9]', '', 'g') AS g
          FROM realizable_report WHERE grp IS NOT NULL),
        have AS (SELECT 'flow_scan' AS population, g, count(*) AS n FROM flows GROUP BY g
          UNION ALL SELECT 'realizable_report', g, count(*) FROM lines GROUP BY g),
        want AS (SELECT plan_id, population, regexp_replace(lower(grp), '[^a-z0-9]', '', 'g') AS g,
          greatest(min_rows, (sample_size * target_ppm + 999999) // 1000000) AS needed FROM sample_targets)
        SELECT w.plan_id, w.g AS grp_slug FROM want w LEFT JOIN have h ON w.population = h.population AND w.g = h.g
        WHERE coalesce(h.n, 0) < w.needed""",
    "p7_found": f"{_LEAKED} SELECT item_id, doc_id FROM leaked",
    "p7_items": f"{_LEAKED} SELECT item_id, count(*) AS n_documents, max(n_words) AS n_words FROM leaked GROUP BY item_id",
    "p8_found": f"""WITH {_LIKE} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM forms a JOIN forms b
        ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_canonical": f"WITH {_LIKE} SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY form) AS class_id, form AS canonical FROM forms",
    "p6_found": "SELECT b.bin_kind, d.doc_id FROM documents d, pack_bins b WHERE strlen(d.text) > 0 AND strlen(d.text) + 1 > b.capacity",
}
