"""The stages as SQL over the given tables, which the queries' SQL selects from."""

from __future__ import annotations

from hostsieve.plans import flow

DAY, HOUR, SIZE = 86_400_000_000, 3_600_000_000, 100
_FIELDS = ('"timestamp"', "status_code", "client_ip", "dns_server_ip", "domain_name", "record_type", "response_ip", "size")
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def sql_entropy(text: str) -> str:
    """SQL for the entropy of a text's characters."""
    p = f"((length({text}) - length(replace({text}, c, ''))) / length({text}))"
    each = f"list_transform(list_filter(list_distinct(string_split({text},'')), lambda c: c <> ''), lambda c: -{p} * log2({p}))"
    return f"CASE WHEN length({text}) > 0 THEN list_sum({each}) ELSE 0.0 END"


#: Steps as SQL over the same tables; a query's SQL selects from these.
STEPS = f"""
h AS (SELECT page_id, regexp_extract(url,'^[a-z]+://([^/:?#]+)',1) host FROM pages), np AS (SELECT count(*) c FROM pages),
made AS (SELECT event_id logline_id, epoch_us(ts) us, CASE WHEN event_id % 89 = 7 THEN strftime(ts,'%Y-%m-%d')
  ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S.%fZ') END AS "timestamp",
 CASE WHEN event_type='error' THEN 'NXDOMAIN' ELSE 'NOERROR' END status_code,
 CASE WHEN user_id % 29 = 3 THEN 'fd00:0:0:' || (user_id % 7 + 1) || '::' || (user_id % 251 + 1) ELSE '192.168.' || (user_id % 7) || '.'
  || (user_id % 251 + 1) END client_ip, '10.10.0.' || (event_id % 10 + 1) dns_server_ip,
 CASE WHEN event_id % 173 = 11 THEN repeat('abcdefghi.', 26) || 'com' WHEN event_id % 4 = 0 THEN substr(md5(cast(event_id AS varchar)),1,16) || '.com'
  ELSE host END domain_name,
 CASE WHEN event_id % 11 = 0 THEN 'CNAME' WHEN event_id % 2 = 0 THEN 'A' ELSE 'AAAA' END record_type,
 CASE WHEN event_id % 101 = 0 THEN '10.0.0.300' ELSE '10.0.0.' || (event_id % 250 + 1) END response_ip,
 cast(floor(value) AS int) || 'b' size, CASE WHEN event_id % 4 = 0 THEN 'dga' ELSE 'legit' END class
 FROM events CROSS JOIN np JOIN h ON h.page_id = event_id % np.c),
lines AS (SELECT *, CASE WHEN logline_id % 211 = 1 THEN '  ' WHEN logline_id % 97 = 5 THEN concat_ws(' ',{",".join(_FIELDS[:-1])})
  ELSE concat_ws(' ',{",".join(_FIELDS)}) END AS value FROM made),
tests AS (SELECT *, CASE WHEN trim(value) = '' THEN 0 ELSE len(string_split(trim(value),' ')) END n_fields,
  try_strptime("timestamp",'%Y-%m-%dT%H:%M:%S.%fZ') IS NOT NULL ok_ts,
 record_type IN ('A','AAAA') ok_type, regexp_full_match(response_ip,'{_OCTET}(\\.{_OCTET}){{3}}') ok_ip,
 length(domain_name) <= 253 AND regexp_full_match(domain_name,'([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,63}}') ok_domain,
  regexp_full_match(size,'[0-9]+b') ok_size FROM lines),
valid AS (SELECT *, CASE WHEN contains(client_ip,':') THEN regexp_replace(client_ip,'::.*$','::') || '_64' ELSE regexp_replace(client_ip,'[0-9]+$','0')
  || '_24' END subnet_id FROM tests WHERE n_fields = 8 AND ok_ts AND ok_type AND ok_ip AND ok_domain AND ok_size),
by_size AS (SELECT *, (row_number() OVER (PARTITION BY subnet_id ORDER BY us, logline_id) - 1) // {SIZE} b FROM valid),
by_time AS (SELECT *, us // {DAY} b FROM valid),
own AS (SELECT subnet_id, b, min(us) own_begin, max(us) end_us, count(*) n FROM by_time GROUP BY ALL),
bnd AS (SELECT o.subnet_id, o.b, coalesce(p.own_begin, o.own_begin) begin_us, o.end_us, o.n, coalesce(p.n, 0) n0, o.subnet_id || '#' || o.b batch_id
  FROM own o LEFT JOIN own p ON p.subnet_id = o.subnet_id AND p.b = o.b - 1),
batches AS (SELECT t.* EXCLUDE (b), x.b, x.batch_id, x.begin_us, x.end_us, CASE WHEN t.b = x.b THEN 1 ELSE 0 END part FROM by_time t
  JOIN bnd x ON x.subnet_id = t.subnet_id AND (x.b = t.b OR x.b = t.b + 1)),
relevant AS (SELECT * FROM batches WHERE status_code = 'NXDOMAIN'),
axis AS (SELECT batch_id, begin_us, unnest(range(0, cast(ceil((end_us - begin_us + {HOUR}) / {HOUR}) AS bigint))) step FROM bnd),
placed AS (SELECT *, (us - begin_us) // {HOUR} step FROM relevant WHERE us BETWEEN begin_us AND end_us),
per AS (SELECT batch_id, step, count(*) n, avg(cast(replace(size,'b','') AS int)) size FROM placed GROUP BY ALL),
series AS (SELECT a.batch_id, a.step, coalesce(n,0) n, coalesce(size,0.0) size FROM axis a LEFT JOIN per p ON p.batch_id = a.batch_id AND p.step = a.step),
raw_score AS (SELECT batch_id, step, n, CASE WHEN count(n) OVER w < 5 OR stddev_pop(n) OVER w = 0 THEN 0.0
  ELSE coalesce(abs(n - avg(n) OVER w) / stddev_pop(n) OVER w, 0.0) END s FROM series
  WINDOW w AS (PARTITION BY batch_id ORDER BY step ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
scored AS (SELECT *, 1 - exp(-s / 3) score FROM raw_score),
suspicious AS (SELECT batch_id, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) share FROM scored GROUP BY 1 HAVING avg(CASE
  WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) > 0.01),
clients AS (SELECT r.*, md5(r.batch_id || '|' || client_ip) suspicious_batch_id FROM relevant r JOIN suspicious USING (batch_id)),
entropy AS (SELECT domain_name, {sql_entropy("domain_name")} fqdn_entropy FROM (SELECT DISTINCT domain_name FROM valid)),
probable AS (SELECT domain_name, fqdn_entropy, CASE WHEN len(string_split(domain_name,'.')) = 2 AND fqdn_entropy > 3.3 THEN least(1.0, fqdn_entropy / 4)
  ELSE 0.0 END p1 FROM entropy),
warned AS (SELECT c.*, p1 FROM clients c JOIN probable USING (domain_name) WHERE p1 > 0.5),
alerts AS (SELECT suspicious_batch_id, batch_id, client_ip, median(p1) overall_score, list_sort(list(DISTINCT domain_name)) domain_names, max(us) alert_us,
  count(*) n_warnings,
 '[' || string_agg('{{"request":"' || domain_name || '","probability":' || round(p1,6) || ',"model":"rule","sha256":""}}', ',' ORDER BY domain_name)
  || ']' AS result FROM warned GROUP BY ALL),
judged AS (SELECT logline_id, subnet_id, domain_name, class, record_type, fqdn_entropy, CASE WHEN class='legit' THEN 0 ELSE 1 END label, CASE
  WHEN p1 > 0.5 THEN 1 ELSE 0 END prediction FROM valid JOIN probable USING (domain_name)),
conf AS (SELECT count(*) FILTER (label=1 AND prediction=1) tp, count(*) FILTER (label=0 AND prediction=1) fp, count(*) FILTER (label=1 AND prediction=0) fn,
  count(*) FILTER (label=0 AND prediction=0) tn FROM judged),
lv AS (SELECT *, string_split(domain_name,'.') labels FROM valid),
levels AS (SELECT *, domain_name fqdn, CASE WHEN len(labels)>1 THEN labels[-2] ELSE '' END secondleveldomain, CASE
  WHEN len(labels)>1 THEN array_to_string(labels[:-3],'.') ELSE '' END thirdleveldomain FROM lv),
bc AS (SELECT b.*, coalesce(m,0) m, s.batch_id IS NOT NULL bad FROM bnd b LEFT JOIN (SELECT batch_id, count(*) m FROM relevant
  GROUP BY 1) r ON r.batch_id = b.batch_id LEFT JOIN suspicious s ON s.batch_id = b.batch_id),
bev AS (SELECT batch_id AS key, '{flow.BATCHES}' stage, 'completed' status, true is_active, end_us us, n message_count, 2 rank FROM bc
 UNION ALL SELECT batch_id, '{flow.PREFILTER}', 'in_process', true, end_us, n + n0, 3 FROM bc
 UNION ALL SELECT batch_id, '{flow.PREFILTER}', CASE WHEN m > 0 THEN 'finished' ELSE 'filtered_out' END, m > 0, end_us, m, 4 FROM bc
 UNION ALL SELECT batch_id, '{flow.INSPECTOR}', 'in_process', true, end_us, m, 5 FROM bc WHERE m > 0
 UNION ALL SELECT batch_id, '{flow.INSPECTOR}', 'filtered_out', false, end_us, m, 6 FROM bc WHERE m > 0 AND NOT bad
 UNION ALL SELECT subnet_id || '#' || b, '{flow.BATCHES}', 'waiting', true, us, row_number() OVER (PARTITION BY subnet_id, b ORDER BY us, logline_id), 1
  FROM by_time),
sev AS (SELECT suspicious_batch_id AS key, client_ip, us, m message_count, unnest(['{flow.INSPECTOR}','{flow.DETECTOR}','{flow.DETECTOR}']) stage,
  unnest(['finished','in_process', CASE WHEN found THEN 'finished' ELSE 'filtered_out' END]) status, unnest([true,true,false]) is_active, unnest([1,2,3]) rank
 FROM (SELECT c.suspicious_batch_id, c.client_ip, max(c.end_us) us, count(*) m, c.suspicious_batch_id IN (SELECT suspicious_batch_id FROM alerts) found
  FROM clients c GROUP BY ALL)),
lev AS (SELECT logline_id AS key, us, unnest(['{flow.COLLECTOR}','{flow.COLLECTOR}','{flow.BATCHES}','{flow.BATCHES}']) stage,
  unnest(['in_process','finished','in_process','batched']) status, true is_active, unnest([1,2,3,4]) rank FROM valid
 UNION ALL SELECT logline_id, us, '{flow.PREFILTER}', 'filtered_out', false, 5 FROM valid WHERE status_code <> 'NXDOMAIN'
 UNION ALL SELECT logline_id, end_us, '{flow.INSPECTOR}', 'filtered_out', false, 6 FROM (SELECT DISTINCT logline_id, batch_id, end_us FROM relevant
  WHERE batch_id NOT IN (SELECT batch_id FROM suspicious))
 UNION ALL SELECT logline_id, end_us, '{flow.DETECTOR}', CASE WHEN suspicious_batch_id IN (SELECT suspicious_batch_id FROM alerts) THEN 'detected'
  ELSE 'filtered_out' END, false, 7 FROM (SELECT DISTINCT logline_id, suspicious_batch_id, end_us FROM clients))
"""
