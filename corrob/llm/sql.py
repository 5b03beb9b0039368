"""DuckDB SQL for the queries that SQL can express."""

from corrob.llm.urls import BIN, BINS, LOWER, ORDER, RULES, UNIFORM, UNIT, UPPER

ORACLE: dict[str, str] = {}

ORACLE["op6_decontamination"] = r"""
with item as (
  select distinct cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null
), item_window as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') said
  from (select item, w, least(10, len(w)) n, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from item where len(w) > 0)
), doc as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents
), size as (select distinct n from item_window),
doc_window as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') said
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from doc, size where len(w) >= n)
), hit as (select d.r, d.i, d.n, k.item from doc_window d join item_window k using (n, said)),
word as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from (select distinct r, i, n from hit)) group by r),
named as (select r, list_sort(list(distinct item)) items from hit where item is not null group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, cast(coalesce(len(items), 0) as bigint) n_items,
  sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join word using (r) left join named using (r)
"""

_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0]))


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')"


def _levels() -> str:
    """Tables t (runs), c (what follows contexts) and p (probabilities under both models) of each order."""
    out = []
    for k in range(ORDER + 1):
        low = (lambda m: f"{UNIFORM}::double") if not k else (lambda m: f"p.p{m}")
        p = ", ".join(f"case when s{m} > 0 then (n{m} + t{m} * {low(m)}) / (s{m} + t{m})::double else {low(m)} end p{m}" for m in "ab")
        out.append(f"""t{k} as (select right(run, {k + 1}) run, left(right(run, {k + 1}), {k}) context, sum(na) na, sum(nb) nb from counts group by all),
c{k} as (select context, sum(na) sa, sum(nb) sb, count(*) filter (na > 0) ta, count(*) filter (nb > 0) tb from t{k} group by context),
p{k} as (select t.run, {p} from t{k} t join c{k} c on c.context = t.context{f" join p{k - 1} p on p.run = right(t.run, {k})" if k else ""})""")
    return ",\n".join(out)


ORACLE["op2_url_filter"] = rf"""
with rest as (select row_number() over () as row, page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
parts as (select row, page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from rest),
ruled as (select *, case {" ".join(f"when {_fits(r)} then '{r}'" for r, _ in _BY_LENGTH)} end as rule from parts),
read as (select *, case rule {" ".join(f"when '{r}' then '{v}'" for r, v in RULES)} end known, substr(md5(url), 1, 1) < '4' later,
  repeat(chr(2), {ORDER}) || translate(url, '{UPPER}', '{LOWER}') || chr(3) marked from ruled),
runs as (select row, known, later, substr(marked, i, {ORDER + 1}) run from (select row, known, later, marked, unnest(range(1, len(marked) - {ORDER} + 1)) i from read)),
counts as (select run, count(*) filter (known = 'allow' and not later) na, count(*) filter (known = 'block' and not later) nb from runs group by run),
{_levels()},
ratio as (select run, cast(floor((ln(pa) - ln(pb)) * {UNIT} + 0.5) as bigint) q from p{ORDER}),
means as (select row, sum(q)::double / count(*) mean from runs join ratio using (run) group by row),
scored as (select read.*, coalesce(mean, 0.0)::double mean from read left join means on means.row = read.row),
bins as (select bin, count(*) filter (known = 'allow') a, count(*) filter (known = 'block') b from (
  select known, greatest(0, least({BINS - 1}, floor(mean / {BIN}) + {BINS // 2})) bin from scored where known is not null and later) group by bin),
gains as (select bin, coalesce((sum(a) over (order by bin rows between current row and unbounded following))::double / nullif(sum(a) over (), 0), 0)
  + coalesce((sum(b) over (order by bin rows between unbounded preceding and 1 preceding))::double / nullif(sum(b) over (), 0), 0) gain,
  (bin + coalesce(lag(bin) over (order by bin), bin)) / 2 middle from bins),
best as (select coalesce((max_by(middle, [gain, -bin]) - {BINS // 2}) * {BIN}.0, 0.0)::double least_ from gains)
select page_id, host, path, rule, coalesce(known, case when mean >= least_ then 'allow' else 'block' end) verdict, mean / {UNIT} score, least_ / {UNIT} threshold
from scored, best
"""

#: CRCs bit by bit, words by runs of letters, near words by the places of a deleted code point, roots by recursion.
ORACLE["op13_spelling_variants"] = f"""with recursive bit as (select i, i c, 0 k from range(256) r(i) union all select i, xor(c >> 1, (c & 1) * 3988292384), k + 1 from bit where k < 8), tab as (select list(c order by i) t from bit where k = 8),
runs as (select doc_id, r, count(*) k from (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{5,}}')) r from documents) group by all),
coded as (select *, hex(encode(doc_id || ':' || r)) x from runs),
hashed as (select doc_id, r, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x), 2), lambda i: ('0x' || x[i + 1 : i + 2])::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) h from coded, tab),
named as (select case when h % 97 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end word, k from hashed),
words as (select word, cast(sum(k) as bigint) n from named where length(word) >= 5 group by word having sum(k) >= 3),
cut as (select word, i, substr(word, 1, i) || substr(word, i + 2) rest from (select word, unnest(range(length(word))) i from words)),
pairs as (select a.word a, b.word b from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word union select c.word, w.word from cut c join words w on w.word = c.rest union select w.word, c.word from cut c join words w on w.word = c.rest),
ranked as (select a, b, n, count(*) over (partition by a) n_near, row_number() over (partition by a order by n desc, b) rn from pairs join words on word = b),
found as (select w.word, w.n, coalesce(n_near, 0) n_near, case when r.n >= 2 * w.n then b end form, case when r.n >= 2 * w.n then r.n end form_n from words w left join ranked r on r.a = w.word and rn = 1),
chain as (select word, form place from found where form is not null union all select c.word, f.form from chain c join found f on f.word = c.place where f.form is not null),
ends as (select c.word, c.place root from chain c join found f on f.word = c.place where f.form is null)
select word, form, coalesce(root, word) root, n, n_near, form_n from found left join ends using (word)"""
