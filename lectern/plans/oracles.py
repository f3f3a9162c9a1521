"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

import re
import unicodedata

from ..functions.validation import UNSEEN
from .queries import NAMES, URLS

#: White space of all scripts, for RE2, whose own class has ASCII only.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_WORDS = r"""
w0 AS (SELECT conv_id AS job_id, turn AS segment_id, string_split_regex(trim(text, E' \n'), '\s+') AS ws FROM conversations),
w1 AS (SELECT job_id, segment_id, unnest(range(len(ws))) AS word_pos, unnest(ws) AS word FROM w0),
words AS (SELECT *, 400 * (row_number() OVER (PARTITION BY job_id ORDER BY segment_id, word_pos) - 1) AS start_ms FROM w1),
nf AS (SELECT job_id, (3 * (max(start_ms) + 400) + 999) // 1000 AS n_frames FROM words GROUP BY job_id),
ob AS (SELECT job_id, n_frames, unnest(range(0, (n_frames - 1) // 30 + 1)) AS appearance_index FROM nf),
occ AS (SELECT job_id, appearance_index, appearance_index % 5 + 1 AS slide_id, appearance_index * 30 AS start_frame,
        least(appearance_index * 30 + 29, n_frames - 1) AS end_frame FROM ob WHERE appearance_index % 7 <> 6),
linked AS (SELECT w.*, o.slide_id, o.appearance_index FROM words w JOIN occ o ON w.job_id = o.job_id
           AND 3 * (start_ms + 150) >= 1000 * start_frame AND 3 * (start_ms + 150) < 1000 * (end_frame + 1)),
seg AS (SELECT job_id, slide_id, appearance_index, segment_id, min(start_ms) AS start_ms, max(start_ms) + 300 AS end_ms,
        string_agg(word, ' ' ORDER BY start_ms, word_pos) AS text FROM linked GROUP BY ALL),
osp AS (SELECT o.job_id, o.slide_id, o.appearance_index, o.start_frame, coalesce(s.t, '') AS speech_text FROM occ o LEFT JOIN
        (SELECT job_id, appearance_index, string_agg(text, ' ' ORDER BY segment_id) AS t FROM seg GROUP BY ALL) s USING (job_id, appearance_index)),
corpus AS (SELECT job_id, concat_ws('-', appearance_index, segment_id) AS doc, text, start_ms, end_ms, slide_id FROM seg)
"""

_SCORES = """
f AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, value / 5e2 AS p,
      CASE event_type WHEN 'click' THEN 0e0 WHEN 'view' THEN 25e-2 WHEN 'signup' THEN 5e-1 WHEN 'purchase' THEN 75e-2 ELSE 1e0 END AS e,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1e2 AS h, hour(ts) / 24e0 AS s FROM events),
sc0 AS (SELECT job_id, frame_index,
  coalesce(3e-1 * abs(p - lag(p, 2) OVER w) + 25e-2 * abs(e - lag(e, 2) OVER w) + 15e-2 * abs(h - lag(h, 2) OVER w) + 3e-1 * abs(s - lag(s, 2) OVER w), 0e0) AS short,
  coalesce(3e-1 * abs(p - lag(p, 5) OVER w) + 25e-2 * abs(e - lag(e, 5) OVER w) + 15e-2 * abs(h - lag(h, 5) OVER w) + 3e-1 * abs(s - lag(s, 5) OVER w), 0e0) AS medium,
  coalesce(3e-1 * abs(p - lag(p, 10) OVER w) + 25e-2 * abs(e - lag(e, 10) OVER w) + 15e-2 * abs(h - lag(h, 10) OVER w) + 3e-1 * abs(s - lag(s, 10) OVER w), 0e0) AS long
  FROM f WINDOW w AS (PARTITION BY job_id ORDER BY frame_index)),
sc AS (SELECT *, 25e-2 * short + 4e-1 * medium + 35e-2 * long AS combined FROM sc0),
md AS (SELECT job_id, quantile_cont(combined, 5e-1) AS med, quantile_cont(combined, 96e-2) AS p96, quantile_cont(combined, 92e-2) AS p92 FROM sc GROUP BY job_id),
th AS (SELECT job_id, least(med + 5e0 * m, p96) AS strong, greatest(med + 22e-1 * m, least(med + 3e0 * m, p92)) AS recovery FROM
       (SELECT job_id, med, p96, p92, greatest(quantile_cont(abs(combined - med), 5e-1), 1e-5) AS m FROM sc JOIN md USING (job_id) GROUP BY job_id, med, p96, p92)),
nb AS (SELECT *, max(combined) OVER (PARTITION BY job_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near3,
       max(combined) OVER (PARTITION BY job_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near2 FROM sc),
pk AS (SELECT job_id, frame_index, combined FROM nb JOIN th USING (job_id) WHERE frame_index >= 10 AND
       ((combined >= strong AND combined >= near3) OR (combined < strong AND combined >= recovery AND combined >= near2))),
pn AS (SELECT job_id, frame_index, row_number() OVER (PARTITION BY job_id ORDER BY frame_index) AS n FROM pk)
"""

_CAND = """
, fold AS (SELECT job_id, n, frame_index, frame_index AS last, true AS kept FROM pn WHERE n = 1
  UNION ALL SELECT p.job_id, p.n, p.frame_index, CASE WHEN p.frame_index - f.last >= 3 THEN p.frame_index ELSE f.last END, p.frame_index - f.last >= 3
  FROM fold f JOIN pn p ON p.job_id = f.job_id AND p.n = f.n + 1),
cand AS (SELECT job_id, frame_index FROM fold WHERE kept)
"""


def _bm25(corpus: str, job: str, terms: list[str]) -> str:
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    return f"""
post AS (SELECT job_id, doc, term, count(*) AS tf FROM (SELECT job_id, doc, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {corpus}) GROUP BY ALL),
q(term, times) AS (VALUES {values}),
st AS (SELECT (SELECT count(*) FROM {corpus}) AS n, (SELECT sum(tf) FROM post) AS total),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
dl AS (SELECT job_id, doc, sum(tf) AS dl FROM post GROUP BY ALL),
hit AS (SELECT doc, -sum(times * CASE WHEN ln((n - df + 5e-1) / (df + 5e-1)) <= 0 THEN 1e-6 ELSE ln((n - df + 5e-1) / (df + 5e-1)) END
        * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / (total / n)))) AS rank
        FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (job_id, doc), st WHERE job_id = {job} GROUP BY doc)
"""


_JOB = "(SELECT min(conv_id) FROM conversations WHERE text LIKE '% the %')"
_CONFIRMED = """
, conf AS (SELECT c.job_id, c.frame_index FROM cand c JOIN sc USING (job_id, frame_index) JOIN f r ON r.job_id = c.job_id AND r.frame_index = greatest(0, c.frame_index - 5)
  JOIN f x ON x.job_id = c.job_id AND x.frame_index BETWEEN c.frame_index AND c.frame_index + 2
  WHERE 3e-1 * abs(x.p - r.p) + 25e-2 * abs(x.e - r.e) + 15e-2 * abs(x.h - r.h) + 3e-1 * abs(x.s - r.s) >= sc.combined * 45e-2 GROUP BY ALL HAVING count(*) >= 2),
grp AS (SELECT s.job_id, s.frame_index, sum(CASE WHEN c.job_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.job_id ORDER BY s.frame_index) AS appearance_index FROM sc s LEFT JOIN conf c USING (job_id, frame_index)),
app AS (SELECT job_id, CAST(appearance_index AS BIGINT) AS appearance_index, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frame_count FROM grp GROUP BY job_id, appearance_index)
"""
_PLANTED = """
e0 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e1 AS (SELECT id, v FROM e0 UNION ALL SELECT id + 1000000, list_transform(v, lambda x, i: CASE id % 4 WHEN 0 THEN CASE WHEN (i - 1 + id) % 21 = 0 THEN -x ELSE x END WHEN 1 THEN x * 101e-2 WHEN 2 THEN x * 5e-1 ELSE -x END) FROM e0),
pl AS (SELECT id, v, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM e1)
"""
_BITS = "CAST(list_sum(list_transform(list_zip(x.s, y.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER)"


def _unique(job: str, bits: int = 5) -> str:
    return f"""{_PLANTED},
b AS (SELECT id AS i, CAST({job} AS BIGINT) AS job_id, s FROM pl),
pr AS (SELECT y.job_id, x.i AS a, y.i AS b FROM b x JOIN b y ON x.i < y.i AND x.job_id = y.job_id WHERE {_BITS} <= {bits}),
it AS (SELECT b.job_id, b.i, row_number() OVER (PARTITION BY b.job_id ORDER BY b.i) AS n, coalesce(m.m, []) AS m FROM b LEFT JOIN (SELECT job_id, b AS i, list(a ORDER BY a) AS m FROM pr GROUP BY ALL) m USING (job_id, i)),
fold AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS reps FROM it
  UNION ALL SELECT f.job_id, x.n, CASE WHEN list_has_any(f.reps, x.m) THEN f.reps ELSE list_append(f.reps, x.i) END FROM fold f JOIN it x ON x.job_id = f.job_id AND x.n = f.n + 1),
fin AS (SELECT job_id, arg_max(reps, n) AS reps FROM fold GROUP BY job_id),
uq AS (SELECT it.job_id, it.i, CAST(list_position(reps, coalesce(list_min(list_intersect(reps, m)), it.i)) AS BIGINT) AS slide_id FROM it JOIN fin USING (job_id))
"""


_BLOCKS = "(id % 1000000) // 64"
_THIRDS = "(id % 1000000) % 3"
_WINDOWS = [[(y + dy) * 8 + x + dx + 1 for dy in range(7) for dx in range(7)] for y in (0, 1) for x in (0, 1)]
_SSIM = " + ".join(
    f"(SELECT (2 * mx * my + 4e-4) * (2 * (xy - 49 * mx * my) / 48 + 36e-4) / ((mx * mx + my * my + 4e-4) * ((xx - 49 * mx * mx) / 48 + (yy - 49 * my * my) / 48 + 36e-4)) FROM (SELECT list_avg(a) AS mx, list_avg(b) AS my, list_inner_product(a, a) AS xx, list_inner_product(b, b) AS yy, list_inner_product(a, b) AS xy FROM (SELECT list_select(av, {w}) AS a, list_select(bv, {w}) AS b)))"
    for w in _WINDOWS
)
_INNER = [y * 8 + x + 1 for y in range(1, 7) for x in range(1, 7)]
_CASCADE = f"""{_PLANTED},
pr AS (SELECT x.id AS a, y.id AS b, x.v AS av, y.v AS bv FROM pl x JOIN pl y ON x.id < y.id WHERE {_BITS} <= 5),
sm AS (SELECT *, ({_SSIM}) / 4 AS ssim FROM pr),
ed AS (SELECT a, b, ssim, 1 - list_avg(list_transform({_INNER}, lambda i: CASE WHEN (abs(av[i + 1] - av[i - 1]) + abs(av[i + 8] - av[i - 8]) >= 25e-2) <> (abs(bv[i + 1] - bv[i - 1]) + abs(bv[i + 8] - bv[i - 8]) >= 25e-2) THEN 1e0 ELSE 0e0 END)) AS edge FROM sm WHERE ssim >= 92e-2)
"""
_LONG = _SCORES.replace("user_id", "CAST(0 AS BIGINT)")
_URL = (
    "u0 AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{u}')" for i, u in enumerate(URLS)) + rf""")),
u1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g') AS url FROM u0),
u2 AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:', '') AS rest FROM u1),
u3 AS (SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS authority, regexp_replace(regexp_extract(rest, '^(//[^/?#]*)?([^?#]*)', 2), ';[^/]*$', '') AS path FROM u2),
u AS (SELECT *, regexp_extract(authority, '^(.*)@', 1) AS who, regexp_replace(authority, '^.*@', '') AS place FROM u3),
v AS (SELECT *, lower(regexp_extract(place, '^([^:]*)', 1)) AS host, contains(place, ':') AND NOT ends_with(regexp_extract(place, '^[^:]*(:.*)$', 1), ':') AS port, who NOT IN ('', ':') AS userinfo FROM u)"""
)
_HOSTS = "('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be', 'www.youtu.be')"


_REPLACED = """
replaced AS (SELECT job_id, doc, text, start_ms, end_ms, slide_id FROM corpus WHERE (job_id % 3 = 0 AND slide_id = 1) OR (job_id % 3 <> 0 AND job_id % 5 <> 0))
"""
_ID = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)".format
_KEY = lambda kind, *parts: _ID(" || chr(1) || ".join([f"'{kind}'", *(f"CAST({p} AS VARCHAR)" for p in parts)]))
_SAVED = f"""
kept AS (SELECT job_id, slide_id, appearance_index, start_frame, end_frame FROM occ WHERE job_id % 3 <> 0 OR slide_id <= 2),
txt AS (SELECT job_id, slide_id, string_agg(CASE WHEN speech_text <> '' THEN speech_text END, ' ' ORDER BY start_frame, appearance_index) AS t FROM osp GROUP BY ALL),
ssl AS (SELECT {_KEY("slide", "job_id", "slide_id")} AS id, job_id, slide_id, printf('slide_%03d.jpg', slide_id) AS representative_path, coalesce(t, '') AS speech_text FROM (SELECT DISTINCT job_id, slide_id FROM kept) JOIN txt USING (job_id, slide_id)),
soc AS (SELECT {_KEY("shown", "job_id", "slide_id", "appearance_index")} AS id, job_id, {_KEY("slide", "job_id", "slide_id")} AS slide_db_id, appearance_index, start_frame, end_frame, round(start_frame / 3e0, 3) AS start_time, round((end_frame + 1) / 3e0, 3) AS end_time FROM kept),
ssg AS (SELECT {_KEY("said", "job_id", "slide_id", "appearance_index", "segment_id", "start_ms / 1e3")} AS id, job_id, {_KEY("shown", "job_id", "slide_id", "appearance_index")} AS occurrence_id, slide_id, segment_id, start_ms / 1e3 AS start_time, end_ms / 1e3 AS end_time, text
        FROM seg WHERE (job_id % 3 <> 0 OR slide_id <= 2) AND segment_id % 4 <> 3),
docs AS (SELECT job_id, id AS doc, text FROM ssg)
"""
_NAMES = "nm AS (SELECT p_partkey, p_brand || ['.mp4', '.WEBM', '.avi', '.jpg', '.JPG', '.png', '', '.mkv', '.mov', '.jpeg'][p_partkey % 10 + 1] AS name FROM part)"
#: A file name's last part, and how it is stored.
_SAFE = r"""lp AS (SELECT *, coalesce(list_filter(string_split(name, '/'), lambda x: x NOT IN ('', '.'))[-1], '') AS last FROM nm),
st AS (SELECT *, trim(replace(regexp_replace(last, '[^A-Za-z0-9._ -]', '_', 'g'), '..', '_'), ' .') AS kept FROM lp),
sf AS (SELECT *, CASE WHEN kept = '' THEN 'lecture' ELSE kept END AS safe FROM st)"""
_MORE = ", ".join(f"({-1 - i}, '{n}')" for i, n in enumerate(NAMES))
_CALLED = ", ".join(f"{ord(c)}: '{unicodedata.name(c)}'" for a, b in re.findall("(.)(?:-(.))?", UNSEEN) for c in map(chr, range(ord(a), ord(b or a) + 1)))
_JOBS = "SELECT c_custkey AS job_id, c_name AS name, c_acctbal AS total FROM customer"
_DOCS = "dd AS (SELECT lang AS job_id, doc_id AS doc, text FROM documents)"
_LINK = f"WITH {_WORDS} SELECT job_id, segment_id, word_pos, word, slide_id, appearance_index FROM linked"

ORACLES = {
    "clean_text": r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents",
    "format_time": "SELECT o_orderkey, printf('%02d:%02d', CAST(floor(o_totalprice) AS BIGINT) // 60, CAST(floor(o_totalprice) AS BIGINT) % 60) AS shown FROM orders",
    "format_duration": "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)",
    "format_bytes": "SELECT o_orderkey, CASE WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024e0 * 10 + 5e-1) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576e0 * 10 + 5e-1) / 10) ELSE printf('%.2f GB', floor(n / 1073741824e0 * 100 + 5e-1) / 100) END AS shown FROM (SELECT o_orderkey, floor(o_totalprice) * 4096 AS n FROM orders)",
    "safe_filename": f"WITH nm AS (SELECT page_id, url AS name FROM pages UNION ALL SELECT * FROM (VALUES {_MORE})), {_SAFE} SELECT page_id, safe AS name FROM sf",
    "image_basename": r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS name FROM pages",
    "fit_to_page": "SELECT p_partkey, round((842e0 - w * s) / 2, 4) AS x, round((595e0 - h * s) / 2, 4) AS y, round(w * s, 4) AS w, round(h * s, 4) AS h FROM (SELECT p_partkey, p_size * 16e0 AS w, p_retailprice AS h, least(794e0 / (p_size * 16e0), 547e0 / p_retailprice) AS s FROM part)",
    "validate_job_id": "SELECT doc_id, regexp_full_match(CASE WHEN doc_id % 3 = 0 THEN upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) ELSE substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) END, '[0-9a-f]{8}') AS ok FROM documents",
    "validate_query": rf"SELECT doc_id, length(regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g')) BETWEEN 1 AND 200 AS ok, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE length(regexp_replace(text || chr(11) || chr(160), '^{_WHITE}+|{_WHITE}+$', '', 'g')) BETWEEN 1 AND 200 END AS ok_spaced FROM documents",
    "validate_url_api": f"WITH {_URL} SELECT page_id, CASE WHEN scheme <> 'https' THEN 'scheme' WHEN host NOT IN {_HOSTS} THEN 'host' WHEN userinfo THEN 'userinfo' WHEN port THEN 'port' WHEN path = '' THEN 'path' END AS fault FROM v",
    "validate_url_downloader": f"WITH {_URL}, h AS (SELECT * REPLACE (rtrim(host, '.') AS host) FROM v) SELECT page_id, CASE WHEN scheme <> 'https' THEN 'scheme' WHEN userinfo THEN 'userinfo' WHEN port THEN 'port' WHEN host NOT IN {_HOSTS} THEN 'host' WHEN CASE WHEN ends_with(host, 'youtu.be') THEN path IN ('', '/') ELSE NOT regexp_matches(path, '^/(watch|shorts/|embed/)') END THEN 'video' END AS fault FROM h",
    "fps_domain": "SELECT o_orderkey, o_totalprice / 1e5 BETWEEN 1e-1 AND 3e0 AS ok FROM orders",
    "video_size": "SELECT o_orderkey, n > 0 AND n <= 4294967296 AS ok FROM (SELECT o_orderkey, floor(o_totalprice) * 32768 - 67108864 AS n FROM orders)",
    "file_names": rf"WITH {_NAMES}, every AS (SELECT * FROM nm UNION ALL SELECT * FROM (VALUES {_MORE})), {_SAFE.replace('FROM nm', 'FROM every')} SELECT p_partkey, regexp_matches(safe, '(?is).[.](mp4|webm|mov|mkv)$') AS video, regexp_matches(last, '(?is).[.](jpg|jpeg|png)$') AS image, regexp_full_match(name, '(?i)[A-Z0-9_.-]+[.]jpg') AS slide FROM sf",
    "one_source": rf"SELECT page_id, CASE WHEN by_url AND by_video THEN 'both' WHEN NOT by_url AND NOT by_video THEN 'none' END AS fault FROM (SELECT page_id, NOT regexp_full_match(CASE WHEN page_id % 3 > 0 THEN url WHEN page_id % 2 = 0 THEN ' ' ELSE chr(9) || chr(10) END, '{_WHITE}*') AS by_url, page_id % 2 = 0 AND url IS NOT NULL AS by_video FROM pages)",
    "suspicious_unicode": f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(CASE WHEN doc_id % 5 = 0 THEN 'a' || chr(8203) || chr(8238) || text || chr(65279) ELSE text END, '[{UNSEEN}]'), lambda x: printf('U+%04X', unicode(x)) || ' (' || map {{{_CALLED}}}[unicode(x)] || ')'), ' ') AS found FROM documents",
    "storage_filename": r"""WITH a AS (SELECT doc_id, nfc_normalize(CASE WHEN doc_id % 7 = 0 THEN 'con.' || lang WHEN doc_id % 5 = 1 THEN 'e' || chr(769) || ' o' || chr(776) || chr(9) || chr(4352) || chr(4449) || ' ' || text ELSE text || ' . ' END) AS c FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(c, '[<>:"/\\|?*]', '_', 'g'), '[\x00-\x1f]', '', 'g'), '\s+', ' ', 'g')) AS c FROM a),
e AS (SELECT doc_id, rtrim(CASE WHEN c IN ('.', '..') THEN 'lecture' ELSE c END, ' .') AS c FROM b),
g AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '_' || c WHEN c = '' THEN 'lecture' ELSE c END AS c FROM e)
SELECT doc_id, CASE WHEN length(c) > 180 THEN rtrim(substr(c, 1, 180), ' .') ELSE c END AS name FROM g""",
    "image_url": f"WITH {_NAMES} SELECT p_partkey, '/jobs/4c674654/slides/' || url_encode('a b ' || name) AS url FROM nm",
    "preview": "SELECT doc_id, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '...' ELSE text END AS text FROM documents",
    "ratio": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN printf('%.2f', floor(floor(o_totalprice) / 128e0 * 100 + 5e-1) / 100) || '×' ELSE '—' END AS shown FROM orders",
    "corpus_stats": f"WITH {_WORDS}, {_bm25('corpus', '0', ['x'])} SELECT (SELECT count(*) FROM corpus) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_terms, count(DISTINCT term) AS n_distinct, round(sum(tf) / (SELECT count(*) FROM corpus), 6) AS mean FROM post",
    "transcript_words": f"WITH {_WORDS} SELECT job_id, segment_id, CAST(word_pos AS INTEGER) AS word_pos, word, start_ms / 1e3 AS start, (start_ms + 300) / 1e3 AS end FROM words WHERE segment_id % 9 <> 4 AND start_ms // 400 % 11 NOT IN (3, 5, 8, 9)",
    "transcript_faults": f"WITH {_WORDS} SELECT job_id, segment_id, CAST(word_pos AS INTEGER) AS word_pos, CASE start_ms // 400 % 11 WHEN 3 THEN 'object' WHEN 5 THEN 'missing' WHEN 8 THEN 'number' ELSE 'order' END AS fault FROM words WHERE segment_id % 9 <> 4 AND start_ms // 400 % 11 IN (3, 5, 8, 9) UNION ALL SELECT DISTINCT job_id, segment_id, -1, 'words' FROM words WHERE segment_id % 9 = 4",
    "linked_json": f"WITH {_WORDS}, c AS (SELECT job_id, count(DISTINCT slide_id) AS slides, count(*) AS appearances FROM occ GROUP BY job_id), w AS (SELECT job_id, appearance_index, segment_id, count(*) AS n_words FROM linked GROUP BY ALL) SELECT job_id, slides, appearances, seg.slide_id, appearance_index, round((end_frame + 1) / 3e0, 3) AS end_time, segment_id, start_ms / 1e3 AS start, end_ms / 1e3 AS end, text, n_words FROM seg JOIN c USING (job_id) JOIN w USING (job_id, appearance_index, segment_id) JOIN occ USING (job_id, appearance_index)",
    "artifact_listing": r"SELECT conv_id, count(*) AS n, min(CAST(turn AS VARCHAR)) AS first, CAST(sum(strlen(text) + 1) AS BIGINT) AS length FROM conversations GROUP BY conv_id",
    "job_ids": "SELECT count(*) AS n, count(*) AS ok FROM customer",
    "job_record": f"""WITH {_WORDS}, a AS (SELECT job_id, count(DISTINCT segment_id) AS transcript_segments, count(*) AS transcript_words, CASE WHEN job_id % 7 > 0 THEN (max(start_ms) + 300) / 1e3 END AS video_duration_sec FROM words GROUP BY job_id),
b AS (SELECT job_id, count(DISTINCT slide_id) AS unique_slides, count(*) AS slide_appearances, max(end_frame) + 1 AS frames_extracted FROM occ GROUP BY job_id),
t AS (SELECT *, CASE WHEN job_id % 2 > 0 THEN transcript_words * 5e-1 END AS download_time_sec, CASE WHEN job_id % 3 > 0 THEN transcript_words * 125e-3 END AS frame_extraction_time_sec, CASE WHEN job_id % 4 > 0 THEN transcript_words * 25e-2 END AS slide_detection_time_sec, CASE WHEN job_id % 5 > 0 THEN transcript_words * 1e0 END AS transcription_time_sec FROM a JOIN b USING (job_id)),
u AS (SELECT *, coalesce(frame_extraction_time_sec, 0) + coalesce(slide_detection_time_sec, 0) + coalesce(transcription_time_sec, 0) AS total_processing_time_sec FROM t)
SELECT job_id, transcript_words * 1000 AS video_size_bytes, video_duration_sec, CAST(NULL AS DOUBLE) AS processing_fps, 'small.en' AS whisper_model, CAST(NULL AS VARCHAR) AS device, download_time_sec, frame_extraction_time_sec, slide_detection_time_sec, CAST(NULL AS DOUBLE) AS pdf_generation_time_sec, CAST(NULL AS DOUBLE) AS audio_extraction_time_sec, transcription_time_sec, CAST(NULL AS DOUBLE) AS slide_speech_linking_time_sec, CAST(NULL AS DOUBLE) AS database_storage_time_sec, total_processing_time_sec, frames_extracted, unique_slides, slide_appearances, transcript_segments, transcript_words, unique_slides * 2048 AS pdf_size_bytes, CASE WHEN video_duration_sec > 0 THEN round(total_processing_time_sec / video_duration_sec, 4) END AS processing_ratio, CAST(NULL AS DOUBLE) AS peak_memory_mb FROM u""",
    "search_empty": f"WITH {_WORDS} SELECT (SELECT count(*) FROM corpus) AS n_docs, (SELECT count(*) FROM corpus WHERE list_has_any(regexp_extract_all(text, '[a-z]+'), [])) AS total",
    "index_terms": f"WITH {_WORDS}, {_REPLACED}, {_bm25('replaced', '0', ['x'])} SELECT * FROM df",
    "index_lengths": f"WITH {_WORDS}, {_REPLACED}, {_bm25('replaced', '0', ['x'])} SELECT job_id, doc, CAST(coalesce(dl, 0) AS BIGINT) AS dl FROM replaced LEFT JOIN dl USING (job_id, doc)",
    "index_totals": f"WITH {_WORDS}, {_REPLACED}, {_bm25('replaced', '0', ['x'])} SELECT n AS n_docs, CAST(total AS BIGINT) AS n_terms FROM st",
    "search_replaced": f"WITH {_WORDS}, {_REPLACED}, {_bm25('replaced', _JOB + ' + 1', ['the', 'le', 'cafe', 'of', 'the'])} SELECT doc, round(rank, 6) AS rank FROM hit",
    "saved_slides": f"WITH {_WORDS}, {_SAVED} SELECT * FROM ssl",
    "saved_occurrences": f"WITH {_WORDS}, {_SAVED} SELECT * FROM soc",
    "saved_segments": f"WITH {_WORDS}, {_SAVED} SELECT * FROM ssg",
    "saved_again": f"WITH {_WORDS}, {_SAVED}, n AS (SELECT job_id, job_id % 4 = 0 AS anew FROM nf) SELECT job_id, CASE WHEN anew THEN 'again.mp4' ELSE concat('lecture', job_id, '.mp4') END AS video_filename, CASE WHEN NOT anew THEN 3e0 END AS fps, CASE WHEN anew THEN 0 ELSE (SELECT count(*) FROM ssl x WHERE x.job_id = n.job_id) END AS slides, CASE WHEN anew THEN 0 ELSE (SELECT count(*) FROM soc x WHERE x.job_id = n.job_id) END AS occurrences, CASE WHEN anew THEN 0 ELSE (SELECT count(*) FROM ssg x WHERE x.job_id = n.job_id) END AS segments, (SELECT count(*) FROM ssg x WHERE x.job_id = n.job_id) AS indexed FROM n",
    "search_saved": f"WITH {_WORDS}, {_SAVED}, {_bm25('docs', _JOB, ['the', 'of', 'le', 'und'])} SELECT id, text, start_time, end_time, slide_id AS slide_number, printf('slide_%03d.jpg', slide_id) AS image_path, round(rank, 6) AS rank, (SELECT count(*) FROM hit) AS total FROM ssg JOIN hit ON hit.doc = ssg.id ORDER BY start_time, id LIMIT 50",
    "confirmed": f"WITH RECURSIVE {_SCORES} {_CAND} {_CONFIRMED} SELECT * FROM conf",
    "confirmed_appearances": f"WITH RECURSIVE {_SCORES} {_CAND} {_CONFIRMED} SELECT * FROM app",
    "representative": f"WITH RECURSIVE {_SCORES} {_CAND} {_CONFIRMED}, sm AS (SELECT g.job_id, CAST(g.appearance_index AS BIGINT) AS appearance_index, g.frame_index, row_number() OVER (PARTITION BY g.job_id, g.appearance_index ORDER BY 6e-1 * f.e + 4e-1 * ln(1 + f.p * 1e2) DESC, g.frame_index) AS place FROM grp g JOIN app a USING (job_id, appearance_index) JOIN f USING (job_id, frame_index) WHERE a.frame_count <= 12 OR list_contains(list_transform(range(12), lambda j: a.start_frame + j * (a.frame_count - 1) // 11), g.frame_index)) SELECT job_id, appearance_index, frame_index FROM sm WHERE place = 1",
    "unique_slides": f"WITH RECURSIVE {_unique(_THIRDS, 19)} SELECT * FROM uq",
    "slide_numbering": f"WITH RECURSIVE {_unique(_BLOCKS)} SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY min(i)) AS INTEGER) AS slide_number, min(i) AS first_i, count(*) AS n FROM uq GROUP BY job_id, slide_id",
    "word_faults": f"WITH {_WORDS} SELECT job_id, segment_id, word_pos, CASE WHEN start_ms % 7 = 0 THEN 'missing' ELSE 'order' END AS fault FROM words WHERE start_ms % 7 = 0 OR start_ms % 11 = 0",
    "occurrence_faults": f"WITH {_WORDS} SELECT job_id, appearance_index, CASE WHEN appearance_index = 0 THEN 'start' ELSE 'order' END AS fault FROM occ WHERE appearance_index = 0 OR appearance_index % 5 = 1",
    "word_midpoints": f"WITH {_WORDS} SELECT job_id, segment_id, word_pos, start_ms / 1e3 + ((start_ms + 300) / 1e3 - start_ms / 1e3) / 2 AS mid FROM words",
    "stored_segments": f"WITH {_WORDS} SELECT job_id, count(*) AS n FROM (SELECT job_id, CASE WHEN segment_id % 3 = 0 THEN chr(9) || ' ' || chr(8232) ELSE text END AS text FROM seg) WHERE NOT regexp_full_match(text, '{_WHITE}*') GROUP BY job_id",
    "linked_slides": f"WITH {_WORDS}, ev AS (SELECT job_id, unnest(range(1, 8)) AS slide_id FROM (SELECT DISTINCT job_id FROM osp)) SELECT ev.job_id, ev.slide_id, coalesce(string_agg(CASE WHEN speech_text <> '' THEN speech_text END, ' ' ORDER BY start_frame, appearance_index), '') AS speech_text, coalesce(string_agg(CAST(appearance_index AS VARCHAR), ',' ORDER BY start_frame, appearance_index), '') AS shown, count(osp.job_id) AS n_occurrences FROM ev LEFT JOIN osp USING (job_id, slide_id) GROUP BY ALL",
    "numbered_result": f"WITH {_WORDS}, s AS (SELECT DISTINCT job_id, slide_id FROM occ) SELECT job_id, slide_number, path FROM (SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY slide_id) AS INTEGER) AS slide_number, CASE WHEN slide_id % 2 = 1 THEN printf('slide_%03d.jpg', slide_id) END AS path FROM s) WHERE path IS NOT NULL",
    "upsert_job": f"WITH j AS ({_JOBS}) SELECT job_id, CASE WHEN job_id % 3 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN job_id % 3 <> 0 THEN total END AS total FROM j",
    "update_metrics": f"WITH j AS ({_JOBS}) SELECT job_id, name, CASE WHEN job_id % 2 <> 0 THEN total WHEN job_id % 4 > 0 THEN total + 1 END AS total FROM j",
    "survivors_after_delete": f"WITH {_WORDS} SELECT job_id, slide_id, appearance_index FROM occ WHERE job_id % 4 <> 1",
    "schema_migration": "SELECT c_custkey AS job_id, c_name AS name, CAST(NULL AS DOUBLE) AS download_seconds FROM customer",
    "derived_metrics": "SELECT job_id, total, duration, CASE WHEN duration > 0 THEN round(total / duration, 4) END AS processing_ratio FROM (SELECT c_custkey AS job_id, c_custkey * 3e0 AS total, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 * 16e0 - 16e0 END AS duration FROM customer)",
    "frame_budget": "SELECT o_orderkey, ceil(o_totalprice * 3e0) <= 100000 AS ok FROM orders",
    "occurrence_times": f"WITH {_WORDS} SELECT job_id, slide_id, appearance_index, round(start_frame / 3e0, 3) AS start_time, round((end_frame + 1) / 3e0, 3) AS end_time FROM occ",
    "timeline_violations": f"WITH {_WORDS}, l AS (SELECT job_id, appearance_index, slide_id, start_frame, CASE WHEN appearance_index % 4 = 0 THEN end_frame + 5 ELSE end_frame END AS end_frame FROM occ), b AS (SELECT *, lag(end_frame) OVER (PARTITION BY job_id ORDER BY start_frame, end_frame, slide_id) AS before FROM l) SELECT job_id, appearance_index, before FROM b WHERE start_frame < before + 1",
    "link_words": _LINK,
    "link_words_asof": _LINK,
    "linked_segments": f"WITH {_WORDS} SELECT * FROM seg",
    "occurrence_speech": f"WITH {_WORDS} SELECT * FROM osp",
    "slide_speech": f"WITH {_WORDS} SELECT job_id, slide_id, coalesce(string_agg(CASE WHEN speech_text <> '' THEN speech_text END, ' ' ORDER BY start_frame, appearance_index), '') AS speech_text, count(*) AS n_occurrences FROM osp GROUP BY ALL",
    "link_summary": f"WITH {_WORDS} SELECT job_id, count(DISTINCT slide_id) AS slide_count, count(*) AS appearance_count FROM occ GROUP BY ALL",
    "postings": f"WITH {_WORDS}, {_bm25('corpus', '0', ['x'])} SELECT * FROM post",
    "search_bm25": f"WITH {_WORDS}, {_bm25('corpus', _JOB, ['the', 'of', 'and'])} SELECT doc, text, start_ms, end_ms, slide_id, round(rank, 6) AS rank FROM corpus JOIN hit USING (doc) WHERE job_id = (SELECT min(conv_id) FROM conversations WHERE text LIKE '% the %') ORDER BY start_ms, doc LIMIT 50",
    "search_count": f"WITH {_DOCS}, {_bm25('dd', chr(39) + 'en' + chr(39), ['the', 'in'])} SELECT count(*) AS total FROM hit",
    "search_documents": f"WITH {_DOCS}, {_bm25('dd', chr(39) + 'de' + chr(39), ['the', 'in', 'in'])} SELECT doc, round(rank, 6) AS rank FROM hit",
    "transition_scores": f"WITH {_SCORES} SELECT job_id, frame_index, round(short, 10) AS short, round(medium, 10) AS medium, round(long, 10) AS long, round(combined, 10) AS combined FROM sc",
    "robust_threshold": f"WITH {_SCORES} SELECT job_id, round(strong, 10) AS strong, round(recovery, 10) AS recovery FROM th",
    "local_peaks": f"WITH {_SCORES} SELECT job_id, frame_index, round(combined, 10) AS combined FROM pk",
    "candidates": f"WITH RECURSIVE {_SCORES} {_CAND} SELECT * FROM cand",
    "appearances": f"WITH RECURSIVE {_SCORES} {_CAND}, m AS (SELECT s.job_id, s.frame_index, sum(CASE WHEN c.job_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.job_id ORDER BY s.frame_index) AS appearance_index FROM sc s LEFT JOIN cand c USING (job_id, frame_index)) SELECT job_id, CAST(appearance_index AS BIGINT) AS appearance_index, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frame_count FROM m GROUP BY job_id, appearance_index",
    "phash_pairs": f"WITH {_PLANTED}, p AS (SELECT x.id AS a, y.id AS b, {_BITS} AS bits FROM pl x JOIN pl y ON x.id < y.id) SELECT * FROM p WHERE bits <= 19",
    "slide_cascade": f"WITH {_CASCADE} SELECT a, b, round(ssim, 6) AS ssim, round(edge, 6) AS edge FROM ed WHERE edge >= 9e-1",
    "unique_slides_one": f"WITH RECURSIVE {_unique('0')} SELECT * FROM uq",
    "long_scores": f"WITH {_LONG} SELECT frame_index, round(short, 10) AS short, round(medium, 10) AS medium, round(long, 10) AS long, round(combined, 10) AS combined FROM sc",
    "long_threshold": f"WITH {_LONG} SELECT round(strong, 10) AS strong, round(recovery, 10) AS recovery FROM th",
    "long_candidates": f"WITH RECURSIVE {_LONG} {_CAND} SELECT frame_index FROM cand",
    "long_appearances": f"WITH RECURSIVE {_LONG} {_CAND}, m AS (SELECT s.frame_index, sum(CASE WHEN c.job_id IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY s.frame_index) AS appearance_index FROM sc s LEFT JOIN cand c USING (job_id, frame_index)) SELECT CAST(appearance_index AS BIGINT) AS appearance_index, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frame_count FROM m GROUP BY appearance_index",
    "job_metrics": f"WITH {_WORDS} SELECT job_id, count(DISTINCT segment_id) AS segments, count(*) AS words, round((max(start_ms) + 300) / 1e3, 4) AS seconds FROM words GROUP BY job_id",
    "replace_job": f"WITH {_WORDS} SELECT job_id, slide_id, appearance_index FROM occ WHERE job_id % 3 <> 0 UNION ALL SELECT job_id, max(slide_id), 0 FROM occ WHERE job_id % 3 = 0 GROUP BY job_id",
}
