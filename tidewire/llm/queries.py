"""The queries of this subpackage, by name, and SQL for those that SQL expresses."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, collocations, langid, media, minhash, mixing, passages, secrets, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tools whose calls op7 validates.
TOOLS = [
    ("search", '{"type":"object","required":["query"],"properties":{"query":{"type":"string"},"limit":{"type":"integer"}}}'),
    ("calculate", '{"type":"object","required":["expression"],"properties":{"expression":{"type":"string"}}}'),
    ("fetch", '{"type":"object","required":["url"],"properties":{"url":{"type":"string"},"headers":{"type":"object"}}}'),
]


#: Calls that op7 puts into each assistant's message, in the order they are written: each needs some that come later.
CALLS = (
    """{"id":"c', turn, '","name":"fetch","arguments":{"headers":{},"url":"u', turn, '"},"depends_on":["b', turn, '","a', turn - 2, '"]}""",
    """{"id":"b', turn, '","name":"calculate","arguments":{"expression":"1+', turn, '"},"depends_on":["a', turn, '"]}""",
    """{"id":"a', turn, '","name":"search","arguments":{"query":"q', conv_id, '","limit":', LIMIT, '}}""",
)


def with_calls(conversations: DataFrame) -> DataFrame:
    """All messages of conversations, the tables of which hold no calls, with CALLS in each assistant's and some answers.

    A turn counts twice.  An assistant's text becomes the content of a JSON object with three
    calls; in every fourth conversation one has a wrong argument.  Two of three
    assistants' turns are followed by a tool's answer to their call a.
    """
    limit = "if(conv_id % 4 = 0, '\"many\"', cast(turn as string))"
    calls = ",".join(CALLS).replace("LIMIT", limit)
    quoted = "regexp_replace(to_json(array(coalesce(text, ''))), '^.|.$', '')"
    own = conversations.selectExpr("conv_id", "turn * 2 as turn", "role", f"if(role = 'assistant', concat('{{\"content\":', {quoted}, ',\"tool_calls\":[{calls}]}}'), text) as text")
    answers = conversations.where("role = 'assistant' and (conv_id + turn) % 3 <> 0")
    answers = answers.selectExpr("conv_id", "turn * 2 + 1 as turn", "'tool' as role", "concat('{\"tool_call_id\":\"a', turn, '\",\"content\":\"done\"}') as text")
    return own.unionByName(answers)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = ", ".join(f"('{name}', '{schema}')" for name, schema in TOOLS)
    schemas = spark.sql(f"select * from values {tools} as t(tool, parameters)")
    found = chat.format_chats(with_calls(_table(spark, sf_dir, "conversations")), schemas)
    return found.select("conv_id", "turn", "role", "n_calls", "n_linked", "n_valid", "level", F.sha2("message", 256).alias("message_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(f"not {HELD_OUT}"))
    found = toxicity.score(docs, model, spans=False)
    return found.selectExpr("doc_id", f"{HELD_OUT} as held_out", "score", "if(score >= 0.3, 1, 0) as predicted")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=5, percent=85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(_table(spark, sf_dir, "documents"), window=13, texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"), block=64, weights=(5, 2, 1), share=1.5, most=2.0)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(f"not {HELD_OUT}"))
    return langid.predict(docs, model).selectExpr("doc_id", f"{HELD_OUT} as held_out", "lang_pred", "score")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    with open(public_tokenizers.path(ranks), "rb") as file:
        raw = file.read()
    return bpe.encode(_table(spark, sf_dir, "documents"), raw, public_tokenizers.PATTERN, keep_ids=False)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), most=5, least=100, percent=100, top=2000)


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(_table(spark, sf_dir, "documents"), keep=False)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, seed="1:")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clustering_sql(rounds: int = 3) -> str:
    """Centroids and assignments of op13, round by round."""
    steps = [
        """kept as materialized (
  select vec_id, row_number() over () as id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select row_number() over (order by h nulls last, v) - 1 as cluster, v from (select sha256('1:' || vec_id) as h, v from kept order by h nulls last, v limit 16)
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (
  select id, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': d, 'cluster': cluster}}) as best from (
    select id, vec_id, kept.v, cluster, cast(list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from kept, c{r} c
  ) group by id
)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} as materialized (
  select c.cluster, coalesce(m.v, c.v) as v from c{r} c left join (
    select cluster, list((s - ((s % n) + n) % n) // n order by i) as v from (
      select best.cluster as cluster, i, sum(v[i]) as s, count(*) as n from a{r}, range(1, 65) t(i) group by all
    ) group by cluster
  ) m using (cluster)
)"""
            )
    return f"""with {", ".join(steps)}
select vec_id, cast(best.cluster as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.cluster) as bigint) as cluster_inertia,
  cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} c on c.cluster = best.cluster
"""


def _phrases_sql(most: int = 5) -> str:
    """Counts of all phrases by length for op11."""
    return " union all ".join(
        f"select lang, {k} as k, array_to_string(list_slice(w, i, i + {k - 1}), ' ') as phrase from (select lang, w, unnest(range(1, len(w) - {k - 2})) as i from pieces)" for k in range(1, most + 1)
    )


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_toxicity": op8_toxicity,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_media_columns": op12_media_columns,
    "op13_centroid_clustering": op13_centroid_clustering,
}

SQL = {
    "op2_exact_top_k": """
with usable as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from usable q join usable c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select * from ranked where rank <= 5
""",
    "op4_substring_dedup": """
with split as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as key from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from split)
), least as (
  select key, min(doc_id) as low from windows group by key
), covered as (
  select distinct doc_id, i + k as j from windows join least using (key) cross join range(0, 13) r(k) where low < doc_id
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from split
), kept as (
  select doc_id, string_agg(word, ' ' order by j) as text, count(*) as n from words anti join covered using (doc_id, j) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from split left join kept using (doc_id)
""",
    "op7_chat_formatting": """
with said as (
  select conv_id, turn as t, turn * 2 as turn, role, (conv_id + turn) % 3 <> 0 as answered, conv_id % 4 <> 0 as fits,
    case when conv_id % 4 = 0 then '"many"' else cast(turn as varchar) end as lim, text as plain from conversations
), told as (
  select *, case when role = 'assistant' then concat('{"content":', cast(to_json(coalesce(plain, '')) as varchar), ',"tool_calls":[{"id":"c', t, '","name":"fetch","arguments":{"headers":{},"url":"u', t,
    '"},"depends_on":["b', t, '","a', t - 2, '"]},{"id":"b', t, '","name":"calculate","arguments":{"expression":"1+', t, '"},"depends_on":["a', t, '"]},{"id":"a', t,
    '","name":"search","arguments":{"query":"q', conv_id, '","limit":', lim, '}}]}') else plain end as text from said
)
select conv_id, turn, role, cast(if(role = 'assistant', 3, 0) as bigint) as n_calls, cast(if(role = 'assistant' and answered, 1, 0) as bigint) as n_linked,
  cast(case when role <> 'assistant' then 0 when fits then 3 else 2 end as bigint) as n_valid, cast(if(role = 'assistant', 2, 0) as integer) as level,
  sha256(case when role = 'assistant' then cast(to_json({'content': text, 'role': role, 'tool_calls': [
    {'arguments': concat('{"limit":', lim, ',"query":"q', conv_id, '"}'), 'id': concat('a', t), 'level': 0, 'linked': answered, 'name': 'search', 'valid': fits},
    {'arguments': concat('{"expression":"1+', t, '"}'), 'id': concat('b', t), 'level': 1, 'linked': false, 'name': 'calculate', 'valid': true},
    {'arguments': concat('{"headers":{},"url":"u', t, '"}'), 'id': concat('c', t), 'level': 2, 'linked': false, 'name': 'fetch', 'valid': true}]}) as varchar)
    else cast(to_json({'content': text, 'role': role}) as varchar) end) as message_sha256
from told
union all
select conv_id, turn + 1, 'tool', 0, 0, 0, 0, sha256(cast(to_json({'content': concat('{"tool_call_id":"a', t, '","content":"done"}'), 'role': 'tool'}) as varchar)) from said where role = 'assistant' and answered
""",
    "op9_minhash_near_dedup": """
with recursive split as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as s from split where len(w) > 0
), shingles as (
  select doc_id, len(s) as n, unnest(s) as shingle from sets
), links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (
  select doc_id, doc_id as other from split union select r.doc_id, l.b from reach r join links l on l.a = r.other
), found as (
  select doc_id, min(other) as component_id from reach group by doc_id
)
select p.doc_id, cast(coalesce(len(s), 0) as bigint) as n_shingles, component_id, p.doc_id = component_id as kept
from split p join found using (doc_id) left join sets using (doc_id)
""",
    "op10_embedding_near_dedup": """
with recursive units as (
  select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u
  from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
  where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from units a join units b on a.vec_id <> b.vec_id
  where list_sum(list_transform(range(1, len(a.u) + 1), lambda i: a.u[i] * b.u[i])) >= 0.9
), reach as (
  select vec_id, vec_id as other from embeddings union select r.vec_id, l.b from reach r join links l on l.a = r.other
), found as (
  select vec_id, min(other) as component_id from reach group by vec_id
)
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join found using (vec_id)
""",
    "op11_phrase_collocations": f"""
with pieces as (
  select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
  )
), totals as (
  select lang, sum(len(w)) as n from pieces group by lang
), f as materialized (
  select lang, k, phrase, count(*) as c from ({_phrases_sql()}) group by lang, k, phrase having count(*) >= 100
), split as (
  select lang, k, phrase, c, string_split(phrase, ' ') as w from f where k > 1
), cuts as (
  select s.lang, s.k, s.phrase, s.w, s.c as a, t.i, l.c as l, r.c as r, n, cast((1000::hugeint * s.c * n) // (l.c::hugeint * r.c) as bigint) as score
  from split s cross join range(1, 5) t(i) join totals using (lang)
  join f l on l.lang = s.lang and l.phrase = array_to_string(list_slice(s.w, 1, t.i), ' ')
  join f r on r.lang = s.lang and r.phrase = array_to_string(list_slice(s.w, t.i + 1, s.k), ' ')
  where t.i < s.k
), scored as (
  select lang, k, phrase, a, n, arg_min({{'l': l, 'r': r, 'score': score}}, score * 10::hugeint + i) as s from cuts group by lang, k, phrase, a, n
), inside as (
  select distinct p.lang, p.phrase from split p join (
    select lang, c, array_to_string(list_slice(w, i, i + j - 1), ' ') as phrase from split, range(1, 5) t(i), range(2, 5) u(j) where j < k and i + j - 1 <= k
  ) q on q.lang = p.lang and q.phrase = p.phrase and 100 * q.c >= 100 * p.c
), ranked as (
  select lang, row_number() over (partition by lang order by s.score desc, a desc, phrase) as rank, phrase, a, s.l as l, s.r as r, n, s.score as score
  from scored anti join inside using (lang, phrase)
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked where rank <= 2000
""",
    "op13_centroid_clustering": _clustering_sql(),
}
