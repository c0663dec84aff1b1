"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER


def _cut(kind: str, pattern: str) -> str:
    """The matches of a pattern and what lies between them, made once a text."""
    p = pattern.replace("'", "''")
    return f"regexp_extract_all(t, '{p}') as m_{kind}, string_split_regex(t, '{p}') as g_{kind}"


def _spans(kind: str, ok: str = "true") -> str:
    """A list of {s, v}, start and value, of the matches: running sums over what lies between them and the matches."""
    return (
        f"list_filter(list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'s': cast(list_sum(list_transform(g_{kind}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{kind}[1:i-1], lambda y: length(y))), 0) as bigint), "
        f"'v': m_{kind}[i]}}), lambda x: {ok}) as {kind}"
    )


def _text(kind: str) -> str:
    return f"list_transform({kind}, lambda x: '{kind}:'||x.s||':'||(x.s+length(x.v)))"


_DIGITS = "regexp_replace(x.v,'[^0-9]','','g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: case when i%2=1 then (case when 2*cast(reverse({_DIGITS})[i+1] as int)>9 then 2*cast(reverse({_DIGITS})[i+1] as int)-9 else 2*cast(reverse({_DIGITS})[i+1] as int) end) else cast(reverse({_DIGITS})[i+1] as int) end))%10=0"
_IBAN = "replace(x.v,' ','')"
_MOD97 = f"list_reduce(list_transform(string_split(substr({_IBAN},5)||substr({_IBAN},1,4), ''), lambda c: cast(case when ascii(c)>=65 then ascii(c)-55 else ascii(c)-48 end as bigint)), lambda a, b: case when b>=10 then (a*100+b)%97 else (a*10+b)%97 end, cast(0 as bigint))=1"
_NEAR = "regexp_matches(lower(substr(t, greatest(x.s-40,0)+1, x.s-greatest(x.s-40,0))||' '||substr(t, x.s+length(x.v)+1, 40)), 'ssn|social|security|insurance')"
#: RE2 knows no look-around: what stands around a match is tested afterwards.
_EDGE = "not regexp_matches(substr(t, x.s, 1), '{a}') and not regexp_matches(substr(t, x.s+length(x.v)+1, 1), '{a}')"

_PII = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+",
    "ip": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+",
    "card": "[0-9](?: |-)?(?:[0-9](?: |-)?)*[0-9]",
    "phone": "[+][0-9][ ().0-9-]+[0-9]",
    "iban": "[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9])+(?: ?[A-Z0-9]+)?",
    "ssn": "[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
}
PII = f"""with d as (select doc_id, t, {", ".join(_cut(k, p) for k, p in _PII.items())} from (select doc_id, coalesce(text,'') as t from documents)), f as (select doc_id,
{_spans("email")},
{_spans("ip", "len(list_filter(string_split(x.v,'.'), lambda q: cast(q as hugeint)>255))=0")},
{_spans("card", f"length({_DIGITS}) between 16 and 19 and {_LUHN}")},
{_spans("phone", f"length({_DIGITS}) between 8 and 15")},
{_spans("iban", _EDGE.format(a="[A-Za-z0-9]") + f" and length({_IBAN}) between 12 and 35 and {_MOD97}")},
{_spans("ssn", _EDGE.format(a="[0-9-]") + " and " + _NEAR)}
from d), b as (select *, list_concat(list_concat({_text("email")}, {_text("ip")}), list_concat({_text("card")}, {_text("phone")})) as base, list_concat({_text("iban")}, {_text("ssn")}) as more from f)
select doc_id, cast(len(email) as bigint) as n_email, cast(len(ip) as bigint) as n_ip, cast(len(card) as bigint) as n_card, cast(len(phone) as bigint) as n_phone, sha256(array_to_string(base,',')) as base_sha256, array_to_string(list_concat(base,more),',') as spans, cast(len(iban) as bigint) as n_iban, cast(len(ssn) as bigint) as n_ssn from b"""

_RANKED = "list_transform({k}, lambda x: {{'s': x.s, 'r': {r}, 'e': x.s+length(x.v), 'k': '{k}'}})"


def _merged(kinds: list[str]) -> str:
    parts = [_RANKED.format(k=k, r=i) for i, k in enumerate(kinds)]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"array_to_string(list_transform(list_sort({out}), lambda x: x.k||':'||x.s||':'||x.e), ',')"


_ASSIGN = "(?:(?i:password|passwd|secret|token)|(?i:api_?key))[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9+/_.=-]+"
_VALUE = "regexp_extract(x.v, '^[A-Za-z_]+[\"'']?[ ]*[:=][ ]*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)"
#: Maximal runs of 32 hexadecimal digits or of AKIA and 12 more are what the open patterns leave.
_SECRETS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "prefixed": "gh[pousr]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+"}
SECRETS = f"""with d as (select doc_id, t, {", ".join(_cut(k, p) for k, p in _SECRETS.items())} from (select doc_id, coalesce(text,'') as t from documents)), f as (select doc_id,
{_spans("assign", f"length({_VALUE})>=8")},
{_spans("access")},
{_spans("hex")},
{_spans("pem")},
{_spans("prefixed", "case when starts_with(x.v,'gh') then length(x.v)>=40 else length(x.v)>=15 end")}
from d) select doc_id, cast(len(assign) as bigint) as n_assign, cast(len(access) as bigint) as n_access, cast(len(hex) as bigint) as n_hex, sha256({_merged(["assign", "access", "hex"])}) as base_sha256, {_merged(["assign", "access", "hex", "pem", "prefixed"])} as spans from f"""

EXACT = f"""with d as (select doc_id, translate(coalesce(text,''),'{UPPER}','{LOWER}') as t from documents where doc_id is not null)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256 from d window w as (partition by t)"""

_HEX = "sha1(coalesce(html,''))"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x'||substr({h}, (i//4)*5+1, 5) as bigint) >> (15-5*(i%4))) & 31 as int)+1, 1)".format(h=_HEX)
WARC = f"""with p as (select page_id, cast(strlen(coalesce(html,'')) as bigint) as payload_bytes, array_to_string(list_transform(range(0,32), lambda i: {_LETTER}), '') as payload_digest, min(page_id) over (partition by coalesce(html,'')) as first from pages where page_id is not null)
select page_id, payload_bytes, payload_digest, case when first=page_id then 'response' else 'revisit' end as record_type, case when first<>page_id then first end as refers_to from p"""

#: crc32 byte by byte from its table of 256; words one edit apart by what is left of them without one character.
SPELLING = f"""with recursive t as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as bigint)) else c >> 1 end, cast(i as bigint))) as tab),
runs as (select coalesce(cast(doc_id as varchar),'') as id, unnest(regexp_extract_all(translate(text,'{UPPER}','{LOWER}'), '[a-zÀ-ÿ]+')) as w from documents),
once as (select id, w, count(*) as k, length(w) as len, hex(encode(id||':'||w)) as x from runs where length(w)>=7 group by id, w),
crc as (select w, k, len, xor(list_reduce(range(length(x)//2), lambda c, i: xor(c >> 8, tab[(xor(c, cast('0x'||substr(x, 2*i+1, 2) as bigint)) & 255) + 1]), cast(4294967295 as bigint)), cast(4294967295 as bigint)) as h from once, t),
slipped as (select case when h%31=0 then substr(w,1,cast(h%len as int))||substr(w,cast(h%len as int)+2) else w end as word, k from crc),
words as (select word, cast(sum(k) as bigint) as n from slipped where length(word)>=7 group by word having sum(k)>=2),
gaps as (select word, n, i, substr(word,1,cast(i as int))||substr(word,cast(i as int)+2) as g from words, unnest(range(length(word))) as u(i)),
pairs as (select a.word as a, b.word as b, b.n from gaps a join gaps b on a.g=b.g and a.i=b.i and a.word<>b.word
union select a.word, b.word, b.n from gaps a join words b on a.g=b.word union select b.word, a.word, a.n from gaps a join words b on a.g=b.word),
near as (select a as word, count(*) as n_near, max(n) as best_n, arg_min(b, struct_pack(m := -n, w := b)) as best from pairs group by a),
forms as (select w.word, case when best_n>=10*w.n then best end as form, w.n, coalesce(n_near,0) as n_near, case when best_n>=10*w.n then best_n end as form_n from words w left join near using (word)),
far as (select word, word as tip, 0 as d from forms union all select far.word, forms.form, d+1 from far join forms on forms.word=far.tip where forms.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join (select word, arg_max(tip, d) as root from far group by word) r using (word)"""

ORACLE_SQL = {"op3_exact_dedup": EXACT, "op5_pii": PII, "op6_secrets": SECRETS, "op7_warc": WARC, "op11_spelling": SPELLING}
