"""SQL for the queries of record_log, written on its own, for DuckDB."""

EV = """
WITH RECURSIVE ev AS (
  SELECT user_id + 1 AS record_id, event_id AS ord, event_id // 8 + 1 AS batch_id,
    CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS BIGINT) AS op, props AS value, CAST(strlen(props) AS BIGINT) AS value_bytes,
    CASE WHEN event_type = 'error' THEN 0 ELSE (64 + strlen(props) + 7) - (64 + strlen(props) + 7) % 8 END AS phys
  FROM events
), puts AS (
  SELECT *, log_off // 65536 + 1 AS segment_id, log_off % 65536 + 4096 AS seg_off
  FROM (SELECT *, CAST(sum(phys) OVER (ORDER BY ord) - phys AS BIGINT) AS log_off FROM ev WHERE op = 1)
), final AS (
  SELECT batch_id, record_id, max(ord) AS ord, arg_max(op, ord) AS op, arg_max(value_bytes, ord) AS value_bytes, arg_max(phys, ord) AS phys
  FROM ev GROUP BY batch_id, record_id
), seqs AS (
  SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS commit_seq FROM (SELECT DISTINCT batch_id FROM ev WHERE batch_id % 20 <> 0)
), commits AS (
  SELECT final.*, commit_seq FROM final JOIN seqs USING (batch_id)
), heads AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY commit_seq DESC) AS rn FROM commits) WHERE rn = 1
), live AS (SELECT * FROM heads WHERE op = 1
), live_puts AS (SELECT puts.* FROM puts JOIN live USING (record_id, ord)
), dead_puts AS (SELECT puts.* FROM puts ANTI JOIN live USING (record_id, ord)
), feet AS (
  SELECT segment_id, count(*) AS frames, min(ord) AS first_ord, max(ord) AS last_ord, max(seg_off + phys) AS valid_end FROM puts GROUP BY 1
), stats AS (
  SELECT segment_id, CAST(sum(phys) AS BIGINT) AS live_bytes, count(*) AS live_records FROM live_puts GROUP BY 1
), cand AS (
  SELECT segment_id, coalesce(live_bytes, 0) AS live_bytes, coalesce(live_records, 0) AS live_records, valid_end - 4096 - coalesce(live_bytes, 0) AS reclaimable
  FROM feet LEFT JOIN stats USING (segment_id) WHERE segment_id < (SELECT max(segment_id) FROM feet) AND valid_end - 4096 > coalesce(live_bytes, 0)
), terms AS (
  SELECT b.batch_id, commit_seq, CASE WHEN b.batch_id % 500 = 0 THEN 'OPEN' WHEN b.batch_id % 20 = 0 THEN 'ABORTED' WHEN b.batch_id % 333 = 0 THEN 'UNKNOWN' ELSE 'COMMITTED' END AS state
  FROM (SELECT DISTINCT batch_id FROM ev) b LEFT JOIN seqs USING (batch_id)
), kept AS (
  SELECT batch_id, state, commit_seq FROM (SELECT *, row_number() OVER (PARTITION BY state <> 'UNKNOWN' ORDER BY batch_id DESC) AS rn FROM terms WHERE state <> 'OPEN') WHERE rn <= 64 OR state = 'UNKNOWN'
)
"""

OR = """
WITH RECURSIVE oc AS (
  SELECT o_custkey + 1 AS record_id, o_orderkey + 1 AS commit_seq, CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS op, CAST(strlen(o_orderpriority) AS BIGINT) AS value_bytes FROM orders
), cuts AS (SELECT count(*) * 2 // 3 AS cut, count(*) * 8 // 15 AS own, count(*) * 4 // 5 AS point FROM oc
), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY commit_seq DESC) AS rn FROM oc) WHERE rn = 1
), root AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY commit_seq DESC) AS rn FROM oc WHERE commit_seq <= (SELECT cut FROM cuts)) WHERE rn = 1 AND op = 1
), at_point AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY commit_seq DESC) AS rn FROM oc WHERE commit_seq <= (SELECT point FROM cuts)) WHERE rn = 1
), moved AS (
  SELECT root.record_id, root.commit_seq, root.value_bytes, coalesce(p.op = 1 AND p.commit_seq = root.commit_seq, false) AS applied
  FROM root LEFT JOIN at_point p USING (record_id) WHERE root.commit_seq <= (SELECT own FROM cuts)
)
"""

RX = """
WITH ids AS (SELECT DISTINCT o_custkey * 1000003 + 1 AS id FROM orders
), lv AS (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS level
), sl AS (
  SELECT id, level, CASE WHEN level < 7 THEN id >> CAST(9 * (level + 1) AS INTEGER) ELSE 0 END AS prefix, (id >> CAST(9 * level AS INTEGER)) & 511 AS slot FROM ids, lv
), nd AS (
  SELECT level, prefix, count(DISTINCT slot) AS used FROM sl GROUP BY 1, 2
)
"""
NODE = "CAST(CASE WHEN used < 504 THEN 128 + 8 * used ELSE 4160 END AS BIGINT)"

METRICS = [
    ("commit_queued_total", "counter"), ("commit_groups_total", "counter"), ("commit_group_batches_total", "counter"), ("committed_total", "counter"), ("aborted_total", "counter"), ("conflicts_total", "counter"), ("commit_unknown_total", "counter"), ("queue_wait_nanoseconds_total", "counter"),
    ("validation_nanoseconds_total", "counter"), ("write_sync_nanoseconds_total", "counter"), ("publish_nanoseconds_total", "counter"), ("delta_charged_bytes", "gauge"), ("delta_reserved_bytes", "gauge"), ("delta_soft_limit_bytes", "gauge"), ("delta_hard_limit_bytes", "gauge"), ("mapping_cache_bytes", "gauge"),
    ("gc_started_total", "counter"), ("gc_completed_total", "counter"), ("gc_failed_total", "counter"), ("gc_no_candidate_total", "counter"), ("gc_insufficient_space_total", "counter"), ("gc_copied_bytes_total", "counter"), ("gc_reclaimed_bytes_total", "counter"), ("gc_relocated_records_total", "counter"),
    ("gc_skipped_records_total", "counter"), ("gc_duration_nanoseconds_total", "counter"), ("gc_throttled_nanoseconds_total", "counter"), ("disk_available_estimate_bytes", "gauge"), ("write_stop_free_bytes", "gauge"), ("write_stopped", "gauge"), ("write_stop_rejections_total", "counter"), ("disk_space_check_errors_total", "counter"),
]

CAS = """
cc AS (
  SELECT record_id, seq, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS i,
    CASE WHEN event_type = 'purchase' THEN lag(seq, 2, 0) OVER (PARTITION BY record_id ORDER BY seq) WHEN event_type = 'click' THEN lag(seq, 1, 0) OVER (PARTITION BY record_id ORDER BY seq) END AS expected
  FROM (SELECT user_id + 1 AS record_id, event_id + 1 AS seq, event_type FROM events)
), cr AS (
  SELECT record_id, seq, i, expected IS NULL OR expected = 0 AS accepted, CASE WHEN expected IS NULL OR expected = 0 THEN seq ELSE 0 END AS revision FROM cc WHERE i = 1
  UNION ALL
  SELECT c.record_id, c.seq, c.i, c.expected IS NULL OR c.expected = r.revision, CASE WHEN c.expected IS NULL OR c.expected = r.revision THEN c.seq ELSE r.revision END
  FROM cr r JOIN cc c ON c.record_id = r.record_id AND c.i = r.i + 1
)
"""

_values = {"committed_total": "(SELECT count(*) FROM terms WHERE state = 'COMMITTED')", "aborted_total": "(SELECT count(*) FROM terms WHERE state = 'ABORTED')", "commit_unknown_total": "(SELECT count(*) FROM terms WHERE state = 'UNKNOWN')", "commit_queued_total": "(SELECT count(*) FROM terms)", "conflicts_total": "(SELECT count(*) FROM cr WHERE NOT accepted)", "gc_relocated_records_total": "(SELECT count(*) FROM moved WHERE applied)", "gc_skipped_records_total": "(SELECT count(*) FROM moved WHERE NOT applied)"}
_ALL = EV.rstrip() + "," + CAS.rstrip() + "," + OR.split("WITH RECURSIVE", 1)[1]
_SAMPLES = " UNION ALL ".join(f"SELECT CAST({i + 1} AS BIGINT) AS position, 'lode_{n}' AS name, '{k}' AS kind, CAST({_values.get(n, '0')} AS BIGINT) AS value" for i, (n, k) in enumerate(METRICS))

SQL: dict[str, str] = {
    "put_frames": EV + "SELECT record_id, ord, batch_id, value_bytes, phys, segment_id, seg_off FROM puts",
    "batch_collapse": EV + "SELECT * FROM final",
    "batch_payloads": EV + """SELECT batch_id, mutations, deletes, appended_bytes, surviving_bytes FROM
      (SELECT batch_id, CAST(sum(CASE WHEN op = 1 THEN value_bytes ELSE 0 END) AS BIGINT) AS appended_bytes FROM ev GROUP BY 1) JOIN
      (SELECT batch_id, count(*) AS mutations, count(*) FILTER (op = 2) AS deletes, CAST(sum(CASE WHEN op = 1 THEN value_bytes ELSE 0 END) AS BIGINT) AS surviving_bytes FROM final GROUP BY 1) USING (batch_id)""",
    "commit_seq": EV + "SELECT batch_id, commit_seq FROM seqs",
    "live_heads": EV + "SELECT live.record_id, commit_seq, live.batch_id AS revision, segment_id, seg_off, live.phys FROM live JOIN puts USING (ord)",
    "point_get": EV + "SELECT a.record_id, l.record_id IS NOT NULL AS found, l.batch_id AS revision, l.value_bytes FROM (SELECT CAST(unnest([1, 2, 3, 5, 8, 13, 21, 34, 1000000]) AS BIGINT) AS record_id) a LEFT JOIN live l USING (record_id)",
    "layered_lookup": OR + """, layers AS (
        SELECT record_id, op, commit_seq, CASE WHEN commit_seq > (SELECT cut FROM cuts) THEN 0 WHEN commit_seq > (SELECT own FROM cuts) THEN 1 ELSE 2 END AS layer FROM oc
      ), newest AS (SELECT record_id, layer, arg_max(op, commit_seq) AS op FROM layers GROUP BY 1, 2
      ), seen AS (SELECT record_id, min(layer) AS layer, arg_min(op, layer) AS op FROM newest WHERE layer < 2 OR op = 1 GROUP BY 1)
      SELECT a.record_id, CAST(layer AS BIGINT) AS layer, op FROM (SELECT DISTINCT record_id FROM oc) a LEFT JOIN seen USING (record_id)""",
    "heads_asof_cut": OR + "SELECT record_id, commit_seq, value_bytes FROM root",
    "overlay_merge": OR + "SELECT record_id, commit_seq, value_bytes FROM h WHERE op = 1",
    "tombstones": EV + "SELECT record_id, commit_seq, batch_id FROM heads WHERE op = 2",
    "delta_entries": OR + "SELECT op, count(*) AS entries, 64 * count(*) AS charged_bytes FROM (SELECT record_id, arg_max(op, commit_seq) AS op FROM oc WHERE commit_seq > (SELECT cut FROM cuts) GROUP BY 1) GROUP BY 1",
    "replay_window": EV + "SELECT record_id, ord, segment_id, seg_off FROM puts WHERE (segment_id, seg_off) >= (2, 12288)",
    "history_of_record": EV + "SELECT commit_seq, batch_id, op, lead(commit_seq) OVER (ORDER BY commit_seq) AS replaced_by FROM commits WHERE record_id = 7",
    "log_sequence_check": EV + """, damaged AS (SELECT commit_seq FROM seqs WHERE commit_seq % 50 <> 0 UNION ALL SELECT commit_seq FROM seqs WHERE commit_seq % 70 = 0)
      SELECT 'repeated' AS rule, commit_seq AS value FROM damaged GROUP BY commit_seq HAVING count(*) > 1
      UNION ALL SELECT 'gap', s FROM (SELECT commit_seq AS s, lag(commit_seq, 1, 0) OVER (ORDER BY commit_seq) AS b FROM (SELECT DISTINCT commit_seq FROM damaged)) WHERE s > b + 1""",
    "status_by_batch": EV + """, asked AS (SELECT batch_id FROM terms UNION ALL SELECT unnest([0, 1000001, 2000000]))
      SELECT a.batch_id, CASE WHEN a.batch_id <= 0 THEN 'INVALID' WHEN t.state = 'OPEN' THEN 'OPEN' WHEN k.state IS NOT NULL THEN k.state WHEN a.batch_id BETWEEN 1000000 AND 1000499 THEN 'ABORTED' WHEN a.batch_id < 1000000 THEN 'EXPIRED' ELSE 'NOT_FOUND' END AS status,
        CASE WHEN t.state = 'OPEN' THEN t.commit_seq ELSE k.commit_seq END AS commit_seq
      FROM asked a LEFT JOIN terms t USING (batch_id) LEFT JOIN kept k USING (batch_id)""",
    "status_retention": EV + "SELECT * FROM kept",
    "status_checkpoint": EV + "SELECT count(*) AS terminals, count(*) >= 768 AS needed FROM terms WHERE state <> 'OPEN'",
    "duplicate_terminals": EV + "SELECT batch_id, CAST(2 AS BIGINT) AS terminals FROM terms WHERE state <> 'OPEN' AND batch_id % 40 = 0",
    "condition_conflicts": """SELECT batch_id, record_id, count(*) AS conditions FROM (
        SELECT DISTINCT event_id // 8 + 1 AS batch_id, user_id % 20 + 1 AS record_id, event_type = 'click' AS absent, CASE WHEN event_type = 'click' THEN 0 ELSE event_id % 3 END AS revision
        FROM events WHERE event_type IN ('click', 'view', 'purchase')) GROUP BY 1, 2 HAVING count(*) > 1""",
    "limit_violations": EV + """, b AS (SELECT batch_id, CAST(sum(value_bytes) FILTER (op = 1) AS BIGINT) AS bytes, count(DISTINCT record_id) AS ids, max(value_bytes) FILTER (op = 1) AS largest FROM ev GROUP BY 1)
      SELECT 'batch_bytes' AS rule, batch_id, bytes AS amount FROM b WHERE bytes > 110 UNION ALL SELECT 'batch_mutations', batch_id, ids FROM b WHERE ids > 7 UNION ALL SELECT 'value_bytes', batch_id, largest FROM b WHERE largest > 16""",
    "live_puts": EV + "SELECT record_id, ord, phys, segment_id, seg_off FROM live_puts",
    "dead_puts": EV + "SELECT record_id, ord, phys, segment_id, seg_off FROM dead_puts",
    "verify_report": EV + """SELECT (SELECT count(*) FROM feet) AS data_files, (SELECT count(*) FROM puts) AS put_records, (SELECT CAST(sum(phys) AS BIGINT) FROM puts) AS put_bytes,
      (SELECT count(*) FROM live_puts) AS live_records, (SELECT CAST(sum(phys) AS BIGINT) FROM live_puts) AS live_bytes, (SELECT count(*) FROM dead_puts) AS dead_records, (SELECT CAST(sum(phys) AS BIGINT) FROM dead_puts) AS dead_bytes,
      (SELECT CAST(sum(CASE WHEN batch_id % 20 = 0 THEN 96 ELSE 64 + 32 * n + 128 END) AS BIGINT) FROM (SELECT batch_id, count(*) AS n FROM final GROUP BY 1)) AS system_frame_bytes,
      (SELECT count(*) FROM live) AS mapping_entries, (SELECT max(commit_seq) FROM seqs) AS current_commit_seq""",
    "segment_stats": EV + "SELECT * FROM stats",
    "segment_footer": EV + "SELECT * FROM feet",
    "footer_check": EV + """, own AS (SELECT segment_id, count(*) AS n, min(ord) AS lo, max(ord) AS hi, max(seg_off + phys) AS e FROM puts WHERE ord % 977 <> 5 GROUP BY 1)
      SELECT segment_id, CASE WHEN n IS NULL THEN 'no_frames' WHEN n <> frames THEN 'count' END AS rule FROM feet LEFT JOIN own USING (segment_id) WHERE n IS NULL OR n <> frames""",
    "alias_check": EV + """, a AS (SELECT live.record_id, segment_id, seg_off FROM live JOIN puts USING (ord))
      SELECT segment_id, seg_off, CAST(2 AS BIGINT) AS records FROM a WHERE record_id = (SELECT min(record_id) FROM a WHERE record_id > 1)""",
    "dangling_check": EV + "SELECT c.record_id, c.batch_id, c.ord FROM commits c JOIN puts p ON p.ord = c.ord WHERE c.op = 1 AND p.segment_id = 3 AND p.seg_off < 8192",
    "gc_candidates": EV + "SELECT segment_id, live_bytes, reclaimable FROM cand",
    "gc_pick": EV + "SELECT segment_id, reclaimable FROM cand ANTI JOIN (SELECT DISTINCT segment_id FROM puts WHERE batch_id % 200 = 1) USING (segment_id) ORDER BY reclaimable DESC, segment_id LIMIT 3",
    "gc_space_bound": EV + "SELECT segment_id, 1048576 + live_bytes + 32 * live_records + 2 * 1048576 AS copy_bytes, CAST(ceil(live_records * 8 / 250) AS BIGINT) * 1048576 + 2 * 1048576 AS checkpoint_bytes FROM cand",
    "gc_throttle": EV + "SELECT segment_id, greatest(0.0::DOUBLE, live_bytes / 1024.0::DOUBLE - segment_id::DOUBLE / 128) AS delay FROM cand",
    "gc_resume": """SELECT o_orderkey, CASE
        WHEN p <= 3 AND g < 0 THEN 'give_up' WHEN p <= 3 AND (g > 0 OR p < 3) THEN 'corrupt' WHEN p = 3 AND alive THEN 'give_up' WHEN p = 3 AND listed THEN 'check_empty_and_retire' WHEN p = 3 THEN 'corrupt'
        WHEN g <> 0 THEN 'corrupt' WHEN p = 4 AND listed THEN 'check_empty_and_retire' WHEN p = 5 AND listed THEN 'remove_from_manifest' WHEN p = 5 THEN 'move_to_trash' WHEN p = 6 AND NOT listed THEN 'delete_from_trash' WHEN p = 7 THEN 'finish' ELSE 'corrupt' END AS action
      FROM (SELECT o_orderkey, o_orderkey % 8 + 1 AS p, o_custkey % 3 - 1 AS g, o_orderkey % 3 = 0 AS listed, o_custkey % 2 = 0 AS alive FROM orders)""",
    "relocation_cas": OR + "SELECT record_id, commit_seq, applied FROM moved",
    "relocation_result": OR + "SELECT count(*) AS candidates, count(*) FILTER (applied) AS relocated, count(*) FILTER (NOT applied) AS skipped, CAST(coalesce(sum(value_bytes) FILTER (applied), 0) AS BIGINT) AS copied_value_bytes FROM moved",
    "relocation_chain": """WITH RECURSIVE st AS (
        SELECT record_id, seq, row_number() OVER w AS i, seq % 5 = 0 AS mv, CASE WHEN seq % 10 = 0 THEN lag(seq, 2) OVER w ELSE lag(seq, 1) OVER w END AS ex, CASE WHEN seq % 5 = 0 OR op = 1 THEN seq END AS na
        FROM (SELECT o_custkey + 1 AS record_id, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS op FROM orders) WINDOW w AS (PARTITION BY record_id ORDER BY seq)
      ), r AS (
        SELECT record_id, seq, i, NOT mv AS applied, CASE WHEN mv THEN NULL ELSE na END AS address FROM st WHERE i = 1
        UNION ALL
        SELECT s.record_id, s.seq, s.i, NOT s.mv OR coalesce(r.address = s.ex, false), CASE WHEN NOT s.mv OR coalesce(r.address = s.ex, false) THEN s.na ELSE r.address END FROM r JOIN st s ON s.record_id = r.record_id AND s.i = r.i + 1
      ) SELECT record_id, seq, applied, address FROM r""",
    "gc_after_heads": OR + "SELECT p.record_id, p.commit_seq AS revision, p.value_bytes, m.record_id IS NOT NULL AS moved FROM at_point p LEFT JOIN (SELECT * FROM moved WHERE applied) m USING (record_id) WHERE p.op = 1",
    "radix_slots": RX + "SELECT * FROM sl",
    "radix_lookup": RX + """, q AS (SELECT i * 1000003 + i % 2 AS id FROM range(1, 400) t(i)), have AS (SELECT DISTINCT level, prefix, slot FROM sl)
      SELECT q.id, count(*) AS depth FROM q, lv JOIN have ON have.level = lv.level AND have.prefix = CASE WHEN lv.level < 7 THEN q.id >> CAST(9 * (lv.level + 1) AS INTEGER) ELSE 0 END AND have.slot = (q.id >> CAST(9 * lv.level AS INTEGER)) & 511 GROUP BY 1""",
    "radix_nodes_by_level": RX + f"SELECT level, count(*) AS nodes, CAST(sum({NODE}) AS BIGINT) AS bytes FROM nd GROUP BY 1",
    "node_encoding": RX.replace("SELECT DISTINCT o_custkey * 1000003 + 1 AS id FROM orders", "SELECT o_orderkey + 1 AS id FROM orders") + f"SELECT level, prefix, used, CASE WHEN used < 504 THEN 'sparse' ELSE 'dense' END AS encoding, {NODE} AS bytes FROM nd",
    "dirty_path": RX + "SELECT level, count(DISTINCT prefix) AS rewritten FROM sl WHERE id % 7 = 0 GROUP BY 1",
    "mapping_space": RX + f""", old AS (SELECT level, prefix, count(DISTINCT slot) AS used FROM sl WHERE id % 7 <> 0 GROUP BY 1, 2),
      t AS (SELECT (SELECT CAST(sum({NODE}) AS BIGINT) FROM old) AS first, (SELECT CAST(sum({NODE}) AS BIGINT) FROM nd) AS reachable_bytes, (SELECT CAST(sum({NODE}) AS BIGINT) FROM nd SEMI JOIN (SELECT DISTINCT level, prefix FROM sl WHERE id % 7 = 0) USING (level, prefix)) AS again)
      SELECT first + again AS total_bytes, reachable_bytes, first + again - reachable_bytes AS unreachable_bytes FROM t""",
    "address_codec": EV + "SELECT ord, segment_id * 4294967296 + off AS address, segment_id, off AS seg_off, CASE WHEN off % 8 <> 0 THEN 'alignment' END AS fault FROM (SELECT ord, segment_id, seg_off | 0 + ord % 97 % 2 AS off FROM puts)".replace("seg_off | 0 + ord", "seg_off + ord"),
    "unsigned_ids": "SELECT CAST(u AS VARCHAR) AS id, row_number() OVER (ORDER BY u) AS rank FROM (SELECT CASE WHEN i < 0 THEN i::HUGEINT + 18446744073709551616 ELSE i::HUGEINT END AS u FROM (SELECT (CAST(n_nationkey AS BIGINT) - 12) * 768614336404564650 AS i FROM nation))",
    "reserve_chain": EV + """, g AS (SELECT DISTINCT (batch_id - 1) // 64 AS g FROM final WHERE (batch_id - 1) // 64 <> 6),
      r AS (SELECT g + 1 AS generation, g * 64 + 1 AS prev_high, (g + 1) * 64 + 1 + CASE WHEN g = 10 THEN 8 ELSE 0 END AS new_high FROM g),
      l AS (SELECT *, lag(new_high, 1, 1) OVER (ORDER BY generation) AS b FROM r)
      SELECT 'batch' AS kind, generation, CASE WHEN b <> prev_high THEN 'chain' ELSE 'stride' END AS rule FROM l WHERE b <> prev_high OR new_high - prev_high <> 64""",
    "id_holes": "SELECT r AS record_id FROM range(1, (SELECT count(*) FROM customer) + 1) t(r) ANTI JOIN (SELECT DISTINCT o_custkey + 1 AS r FROM orders WHERE (o_orderkey + 1) % 3 = 0) USING (r)",
    "descriptor_islands": EV + ", n AS (SELECT batch_id, CAST(ceil(count(*) / 2) AS BIGINT) AS parts FROM final WHERE batch_id % 20 <> 0 GROUP BY 1) SELECT batch_id, parts + 1 AS frames, CAST(2 AS BIGINT) AS islands FROM n WHERE batch_id % 97 = 0",
    "frame_checks": """SELECT event_id, kind, fault FROM (SELECT event_id, kind, CASE WHEN kind = 'unknown' THEN 'type'
        WHEN kind = 'put' AND (b = 0 OR r = 0) OR kind IN ('commit_part', 'commit_seal', 'batch_abort') AND (b = 0 OR r <> 0) OR kind = 'id_reserve' AND (b <> 0 OR r <> 0) THEN 'identity'
        WHEN kind = 'commit_part' AND p = 0 OR kind = 'commit_seal' AND p <> 64 OR kind = 'batch_abort' AND p <> 32 OR kind = 'id_reserve' THEN 'payload' END AS fault
      FROM (SELECT event_id, ['put', 'commit_part', 'commit_seal', 'batch_abort', 'id_reserve', 'unknown'][event_id % 6 + 1] AS kind, event_id % 5 AS b, user_id % 2 AS r, event_id % 4 * 32 AS p FROM events)) WHERE fault IS NOT NULL""",
    "journal_transitions": """SELECT operation, step, before, phase FROM (SELECT *, lag(phase) OVER (PARTITION BY operation ORDER BY step) AS before FROM
        (SELECT event_id // 7 AS operation, event_id % 7 AS step, event_id % 7 + 1 + CASE WHEN event_type = 'purchase' AND event_id % 7 = 3 THEN 1 ELSE 0 END AS phase FROM events)) WHERE phase < before OR phase > before + 1""",
    "stats_reconcile": EV + """, then_heads AS (SELECT record_id, arg_max(ord, commit_seq) AS ord, arg_max(op, commit_seq) AS op FROM commits WHERE commit_seq <= 600 GROUP BY 1),
      then_stats AS (SELECT segment_id, CAST(sum(phys) AS BIGINT) AS b, count(*) AS n FROM puts JOIN (SELECT * FROM then_heads WHERE op = 1) t USING (record_id, ord) GROUP BY 1)
      SELECT segment_id, coalesce(b, 0) AS stored_bytes, coalesce(live_bytes, 0) AS found_bytes, coalesce(n, 0) AS stored_records, coalesce(live_records, 0) AS found_records
      FROM then_stats FULL JOIN stats USING (segment_id) WHERE coalesce(b, 0) <> coalesce(live_bytes, 0) OR coalesce(n, 0) <> coalesce(live_records, 0)""",
    "file_set_diff": EV + "SELECT 'segment-2' AS name, 'missing' AS rule FROM feet WHERE segment_id = 2 UNION ALL SELECT 'segment-999', 'unexpected' FROM feet WHERE segment_id = 1",
    "cas_admission": "WITH RECURSIVE " + CAS + " SELECT record_id, seq, accepted, revision FROM cr",
    "group_formation": EV + """, n AS (SELECT batch_id, 24 * count(*) + 64 AS bytes, row_number() OVER (ORDER BY batch_id) AS i FROM final WHERE batch_id % 20 <> 0 GROUP BY 1),
      f AS (
        SELECT batch_id, i, CAST(1 AS BIGINT) AS group_id, CAST(1 AS BIGINT) AS c, bytes AS used FROM n WHERE i = 1
        UNION ALL
        SELECT n.batch_id, n.i, CASE WHEN c >= 64 OR used + bytes > 4096 THEN group_id + 1 ELSE group_id END, CASE WHEN c >= 64 OR used + bytes > 4096 THEN 1 ELSE c + 1 END, CASE WHEN c >= 64 OR used + bytes > 4096 THEN bytes ELSE used + bytes END
        FROM f JOIN n ON n.i = f.i + 1
      ) SELECT batch_id, group_id FROM f""",
    "gc_batches": EV + """, n AS (SELECT segment_id, ord, phys, row_number() OVER (PARTITION BY segment_id ORDER BY ord) AS i FROM puts),
      f AS (
        SELECT segment_id, ord, i, CAST(1 AS BIGINT) AS group_id, CAST(1 AS BIGINT) AS c, phys AS used FROM n WHERE i = 1
        UNION ALL
        SELECT n.segment_id, n.ord, n.i, CASE WHEN c >= 16 OR used + phys > 1000 THEN group_id + 1 ELSE group_id END, CASE WHEN c >= 16 OR used + phys > 1000 THEN 1 ELSE c + 1 END, CASE WHEN c >= 16 OR used + phys > 1000 THEN phys ELSE used + phys END
        FROM f JOIN n ON n.segment_id = f.segment_id AND n.i = f.i + 1
      ) SELECT segment_id, ord, group_id FROM f""",
    "segment_rotation": """WITH RECURSIVE n AS (SELECT doc_id + 1 AS record_id, 64 + strlen(text) + 7 - (64 + strlen(text) + 7) % 8 AS phys, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
      f AS (
        SELECT record_id, i, CAST(1 AS BIGINT) AS segment_id, CAST(4096 AS BIGINT) AS seg_off, 4096 + phys AS pos FROM n WHERE i = 1
        UNION ALL
        SELECT n.record_id, n.i, CASE WHEN phys + 128 > 1048576 - 4096 - pos THEN segment_id + 1 ELSE segment_id END, CASE WHEN phys + 128 > 1048576 - 4096 - pos THEN 4096 ELSE pos END, CASE WHEN phys + 128 > 1048576 - 4096 - pos THEN 4096 ELSE pos END + phys
        FROM f JOIN n ON n.i = f.i + 1
      ) SELECT record_id, segment_id, seg_off FROM f""",
    "disk_admission": EV + """, n AS (SELECT ord // 100 AS w, ord, value_bytes * 8 AS bytes, row_number() OVER (PARTITION BY ord // 100 ORDER BY ord) AS i FROM ev),
      f AS (
        SELECT w, ord, i, 8192 >= bytes + 512 AS admitted, CASE WHEN 8192 >= bytes + 512 THEN 8192 - bytes ELSE 8192 END AS rest FROM n WHERE i = 1
        UNION ALL
        SELECT n.w, n.ord, n.i, rest >= bytes + 512, CASE WHEN rest >= bytes + 512 THEN rest - bytes ELSE rest END FROM f JOIN n ON n.w = f.w AND n.i = f.i + 1
      ) SELECT w AS "window", ord, admitted, CAST(rest AS BIGINT) AS "left" FROM f""",
    "migration_path": """WITH RECURSIVE s AS (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS version_from, CAST(n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 1 END AS BIGINT) AS version_to FROM nation),
      p AS (SELECT CAST(1 AS BIGINT) AS step, * FROM s WHERE version_from = 0 UNION ALL SELECT p.step + 1, s.* FROM p JOIN s ON s.version_from = p.version_to WHERE p.version_to <> 21)
      SELECT * FROM p WHERE EXISTS (SELECT 1 FROM p WHERE version_to = 21)""",
    "manifest_chain": "SELECT CAST(11 AS BIGINT) AS generation, 'generation' AS rule",
    "current_manifest": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS generation, n_name AS name FROM nation ORDER BY n_nationkey DESC LIMIT 1",
    "metric_samples": _ALL + _SAMPLES,
    "metrics_text": _ALL + "SELECT position, '# TYPE ' || name || ' ' || kind || chr(10) || name || '{app=\"lode\",store=\"a\\\"b\\\\c\\nd\"} ' || value || chr(10) AS text FROM (" + _SAMPLES + ")",
    "json_report": EV + "SELECT CAST(json_object('data_files', (SELECT count(*) FROM feet), 'put_records', (SELECT count(*) FROM puts), 'live_records', (SELECT count(*) FROM live_puts), 'live_bytes', (SELECT CAST(sum(phys) AS BIGINT) FROM live_puts), 'dead_records', (SELECT count(*) FROM dead_puts), 'dead_bytes', (SELECT CAST(sum(phys) AS BIGINT) FROM dead_puts)) AS VARCHAR) AS report",
    "soak_values": "SELECT event_id, substr(repeat(user_id || ':' || event_id || ':', CAST((8 + event_id % 57) // length(user_id || ':' || event_id || ':') + 1 AS INTEGER)), 1, CAST(8 + event_id % 57 AS INTEGER)) AS value FROM events",
    "soak_maxima": EV + "SELECT max(l) AS max_logical, max(a) AS max_allocated FROM (SELECT CAST(sum(value_bytes) AS BIGINT) AS l, CAST(sum(phys) AS BIGINT) AS a FROM puts GROUP BY segment_id)",
    "frame_decode": EV + """SELECT segment_id, seg_off, CASE WHEN ok THEN 'put' END AS frame_type, CASE WHEN ok THEN n END AS frame_seq, CASE WHEN ok THEN batch_id END AS batch_id, CASE WHEN ok THEN record_id END AS record_id, CASE WHEN ok THEN value END AS value, CASE WHEN ok THEN phys END AS phys, CASE WHEN NOT ok THEN 'payload checksum' END AS fault
      FROM (SELECT *, row_number() OVER (ORDER BY ord) AS n, seg_off % 4000 <> 96 AS ok FROM puts)""",
    "stream_heads": EV + "SELECT record_id, max(ord) AS ord, arg_max(op, ord) AS op FROM ev WHERE batch_id % 20 <> 0 GROUP BY 1",
}
