"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import fit, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def op2_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_weak import find, fit

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))


def op3_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_lsh import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_bloom import score

    return score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    found = archive_pages(read_table(spark, sf_dir, "pages"))
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .odd_sketch import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import END, START, conversations

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return conversations(rows.unionByName(extra))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import compare_neighbours

    return compare_neighbours(read_table(spark, sf_dir, "documents"))


#: The rules of op11.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import link_statistics

    return link_statistics(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zlib import crc32

    from .periodic_runs import digests, periodic_runs

    def planted(doc_id, n):
        """The contract's repetition in a tenth of the texts (null ids: none)."""
        h = crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10:
            return None
        a = h // 10 % n
        return a, 1 + (n - a) // (3 + h // 10 % 8)

    return digests(periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=planted))


QUERIES = {
    "op1_quality_crf": op1_quality_crf,
    "op7_warc": op7_warc,
    "op9_chat_format": op9_chat_format,
    "op2_pii_weak": op2_pii_weak,
    "op3_embedding_lsh": op3_embedding_lsh,
    "op8_odd_sketch": op8_odd_sketch,
    "op4_packing": op4_packing,
    "op10_spotsigs": op10_spotsigs,
    "op5_lm_bloom": op5_lm_bloom,
    "op6_byte_bpe": op6_byte_bpe,
    "op11_url_filter": op11_url_filter,
    "op12_alignment": op12_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

def _component(ids: str, links: str) -> str:
    """SQL for the smallest id each id reaches over symmetric links (a, b)."""
    return f"""reach(id, other) AS (
          SELECT id, id FROM {ids}
          UNION
          SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other),
        component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


def _url_oracle(rules: dict, order: int = 4) -> str:
    """SQL of op11: rules as a table; the models by one join for each length
    of context."""
    listed = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules.items())
    lengths = range(1, order + 2)
    joins = "".join(f" JOIN g g{n} ON g{n}.gram = right(w, {n}) JOIN c c{n} ON c{n}.context = left(g{n}.gram, {n - 1})" for n in lengths)

    def probability(x: str) -> str:
        p = "(1e0 / (c1.symbols + 1))"
        for n in lengths:
            p = f"CASE WHEN c{n}.n{x} > 0 THEN (g{n}.{x} + c{n}.t{x} * {p}) / CAST(c{n}.n{x} + c{n}.t{x} AS DOUBLE) ELSE {p} END"
        return p

    return f"""WITH rules(rule, host, path, verdict) AS (VALUES {listed}),
        p AS (
          SELECT page_id, row_number() OVER () AS id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        l AS (
          SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            translate(regexp_replace(url, '(?s)^.*?://', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM p),
        u AS (
          SELECT l.page_id, l.id, l.url, l.host, l.path, l.text, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS said
          FROM l LEFT JOIN rules r ON (l.host = r.host OR ends_with(l.host, '.' || r.host)) AND starts_with(l.path, r.path) GROUP BY ALL),
        k AS (SELECT *, rule IS NOT NULL AND NOT substr(md5(url), 1, 1) IN ('0', '1', '2') AS learnt FROM u),
        w AS (
          SELECT id, said, learnt, substr(repeat(chr(2), {order}) || text || chr(3), i, {order + 1}) AS w
          FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM k)),
        d AS (SELECT w, count(*) FILTER (WHERE learnt AND said = 'allow') AS a, count(*) FILTER (WHERE learnt AND said = 'block') AS r FROM w GROUP BY w),
        g AS (SELECT right(w, n) AS gram, sum(a) AS a, sum(r) AS r FROM d, range(1, {order + 2}) t(n) GROUP BY 1),
        c AS (
          SELECT left(gram, length(gram) - 1) AS context, sum(a) AS na, count(*) FILTER (WHERE a > 0) AS ta, sum(r) AS nr,
            count(*) FILTER (WHERE r > 0) AS tr, count(*) AS symbols FROM g GROUP BY 1),
        x AS (SELECT w, CAST(round((ln({probability("a")}) - ln({probability("r")})) * 1000000) AS BIGINT) AS ratio FROM d{joins}),
        s AS (SELECT id, sum(ratio) AS total, count(*) AS places FROM w JOIN x USING (w) WHERE NOT learnt GROUP BY id),
        b AS (
          SELECT CAST(floor(total / places / 10000) AS BIGINT) AS bin, count(*) FILTER (WHERE said = 'allow') AS good,
            count(*) FILTER (WHERE said = 'block') AS bad FROM s JOIN k USING (id) WHERE rule IS NOT NULL GROUP BY 1),
        e AS (
          SELECT (coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) + bin) * 5000 AS cut, (SELECT coalesce(sum(good), 0) FROM b WHERE bin < t.bin) * (SELECT sum(bad) FROM b)
            + (SELECT coalesce(sum(bad), 0) FROM b WHERE bin >= t.bin) * (SELECT sum(good) FROM b) AS errors FROM b t
          WHERE (SELECT sum(good) FROM b) > 0 AND (SELECT sum(bad) FROM b) > 0),
        t AS (SELECT coalesce((SELECT cut FROM e ORDER BY errors, abs(cut), cut LIMIT 1), 0) AS least)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN total >= places * least THEN 'allow' ELSE 'block' END) AS verdict
        FROM k LEFT JOIN s USING (id), t"""


ORACLE: dict[str, str] = {
    "op11_url_filter": _url_oracle(URL_RULES),
    "op3_embedding_lsh": f"""WITH RECURSIVE v AS (
          SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL),
        n AS (SELECT id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE len(x) > 0),
        links AS (
          SELECT p.id AS a, q.id AS b FROM n p JOIN n q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x)
          WHERE p.norm > 0 AND q.norm > 0 AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.93e0),
        ids AS (SELECT vec_id AS id FROM embeddings),
        {_component("ids", "links")}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = c.id) AS n_links, component_id,
               id = component_id AS kept FROM component c""",
    "op7_warc": """WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (
          SELECT page_id, strlen(html) AS bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first,
            list_transform(range(0, 8), lambda j: CAST('0x' || substr(hex, CAST(1 + 5 * j AS INTEGER), 5) AS INTEGER)) AS v
          FROM p)
        SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
          array_to_string(list_transform(v, lambda x:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 15) & 31), 1)
            || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 10) & 31), 1)
            || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 5) & 31), 1)
            || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x & 31), 1)), '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op8_odd_sketch": f"""WITH RECURSIVE w AS (
          SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        u AS (SELECT id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        r AS (
          SELECT id, i, n, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p) AS item
          FROM u WINDOW p AS (PARTITION BY id ORDER BY i)),
        e AS (SELECT DISTINCT id, item FROM r WHERE i = 1 OR i <= n - 3),
        n AS (SELECT id, (SELECT count(*) FROM e WHERE e.id = w.id) AS n FROM w),
        runs AS (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM e p JOIN e q ON p.item = q.item AND p.id <> q.id GROUP BY 1, 2),
        links AS (
          SELECT a, b FROM runs JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
        {_component("n", "links")}
        SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM component JOIN n USING (id)""",
    "op9_chat_format": """WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        c AS (
          SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
            coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
            sum(length('<|im_start|>') + length(role) + 1 + length(text)
                + len(regexp_extract_all(text, '<\\\\*\\|')) + length('<|im_end|>') + 1) AS formatted_chars
          FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c""",
}
