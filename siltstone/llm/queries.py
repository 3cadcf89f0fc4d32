"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bytebpe, langid, linededup, merkle, packing, pseudolm, quality, repeats, secrets, simhash, spotsigs, tokenfiles, whitening
from siltstone.session import table


def over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": over_documents(tokenfiles.op1),
    "op2_simhash_near_dedup": over_documents(simhash.op2),
    "op3_language_id": over_documents(langid.op3),
    "op4_pseudo_likelihood": over_documents(pseudolm.op4),
    "op5_secret_scan": over_documents(secrets.op5),
    "op6_suffix_repeats": over_documents(repeats.op6),
    "op7_spotsigs": over_documents(spotsigs.op7),
    "op8_byte_bpe": over_documents(bytebpe.op8),
    "op9_best_fit_packing": over_documents(packing.op9),
    "op10_quality_rules": over_documents(quality.op10),
    "op11_embedding_whitening": lambda spark, sf_dir: whitening.op11(table(spark, sf_dir, "embeddings")),
    "op12_line_dedup": over_documents(linededup.op12),
    "op13_merkle_manifest": over_documents(merkle.op13),
}

WORD = r"[^\x20\x09-\x0D]+"
OP10 = f"""
with d as (select row_number() over () r, doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
w as (select r, regexp_extract_all(t, '{WORD}') w from d),
tri as (select r, i, [w[i], w[i + 1], w[i + 2]] g from (select r, w, unnest(range(1, len(w) - 1)) i from w where len(w) > 2)),
twice as (select r, i from tri qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct j) n from (select r, unnest([i, i + 1, i + 2]) j from twice) group by r),
raw as (select r, host, unnest(string_split(t, chr(10))) line from d),
ln as (select r, host, line, len(regexp_extract_all(line, '{WORD}')) n, regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g') k from raw where regexp_matches(line, '{WORD}')),
dup as (select r, count(*) - count(distinct line) n from ln group by r),
per as (select r, host, k, sum(n) n from ln group by all),
hosts as (select host, count(*) n from d group by host),
often as (select host, k from per join hosts using (host) group by host, k, hosts.n having count(*) > {quality.LINE_DOCS} and count(*) > hosts.n * {quality.LINE_SHARE}),
gone as (select r, count(*) removed_lines, sum(n)::BIGINT removed_words from per join often using (host, k) group by r),
s as (select doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
  coalesce(removed_lines, 0) removed_lines, coalesce(removed_words, 0) removed_words from d join w using (r) left join dup using (r) left join rep using (r) left join gone using (r)),
f as (select *, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words base_failed from s)
select *, not base_failed and n_words - removed_words >= n_words * {quality.LEAST_KEPT} kept from f"""

OP12 = f"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
s as (select r, doc_id, unnest(l) line, unnest(range(len(l))) i from d),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from s),
o as (select *, length(key) >= {linededup.LEAST_CHARS} and doc_id > min(doc_id) over (partition by key) gone from k)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256 from o group by r, doc_id"""



def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _up(name: str) -> str:
    """The levels above those that a recursive relation starts with."""
    return f"select tree, level + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), max((n + 7) // 8) from {name} where n > 1 group by tree, level, idx // 8"


def _walk(name: str, nodes: str) -> str:
    """One level up for every row: its digest with that of its siblings, and theirs behind those seen before."""
    return f"""select w.r, w.tree, w.level + 1, w.pos // 8, sha256(string_agg(case when s.idx = w.pos then w.cur else s.digest end, '' order by s.idx)), w.sib || coalesce(string_agg(s.digest, '' order by s.idx) filter (where s.idx <> w.pos), ''), (w.n + 7) // 8
  from {name} w join {nodes} s on s.tree = w.tree and s.level = w.level and s.idx // 8 = w.pos // 8 where w.n > 1 group by w.r, w.tree, w.level, w.pos, w.cur, w.sib, w.n"""


CRC = "xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"
OP13 = f"""
with recursive d as (select row_number() over () r, *, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} head, translate(text, '{merkle.UPPER}', '{merkle.LOWER}') low from documents),
h as (select r, doc_id, lang, sha256(head || {_field("text")}) leaf, case when doc_id is not null and {CRC} % 3 = 0 then sha256(head || {_field("low")}) else sha256(head || {_field("text")}) end tampered from d),
lf as (select *, dense_rank() over (order by lang nulls first) - 1 tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by lang) n from h),
nd(tree, level, idx, digest, n) as (select tree, 0, idx, leaf, n from lf union all {_up("nd")}),
sub as (select tree, digest subroot, count(*) over () n_trees from nd where n = 1),
tp(tree, level, idx, digest, n) as (select -1, 0, tree, subroot, n_trees from sub union all {_up("tp")}),
w1(r, tree, level, pos, cur, sib, n) as (select r, tree, 0, idx, tampered, '', n from lf union all {_walk("w1", "nd")}),
w2(r, tree, level, pos, cur, sib, n) as (select r, -1, 0, w1.tree, cur, sib, n_trees from w1 join sub using (tree) where n = 1 union all {_walk("w2", "tp")})
select doc_id, leaf, subroot, t.digest root, sha256(sib) proof_sha256, cur folded_root, cur = t.digest verified from lf join sub using (tree) join w2 on w2.r = lf.r and w2.n = 1 join tp t on t.n = 1"""

ORACLES: dict[str, str] = {"op10_quality_rules": OP10, "op12_line_dedup": OP12, "op13_merkle_manifest": OP13}
