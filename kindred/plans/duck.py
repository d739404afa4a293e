"""Pieces of DuckDB SQL for the oracle queries."""

SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def fold0(x: str) -> str:
    return f"strip_accents(lower({x}))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def fold(x: str) -> str:
    return collapse(fold0(x))


def tri(x: str) -> str:
    """Distinct trigrams of a folded text."""
    return rf"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jac(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE), 0), 0.0)"


def bi(x: str) -> str:
    return f"CASE WHEN length({x}) >= 2 THEN list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)) ELSE [] END"


def dice(a: str, b: str) -> str:
    shared = f"coalesce(list_sum(list_transform(list_intersect({bi(a)}, {bi(b)}), lambda g: least(len(list_filter({bi(a)}, lambda v: v = g)), len(list_filter({bi(b)}, lambda v: v = g))))), 0)"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * CAST({shared} AS DOUBLE) / (length({a}) - 1 + length({b}) - 1) END"


def once(x: str, prefixes: tuple[str, ...]) -> str:
    return f"regexp_replace({x}, '^({'|'.join(prefixes)}) ', '')"


def loop(x: str, prefixes: tuple[str, ...]) -> str:
    for p in prefixes:
        x = f"regexp_replace({x}, '^{p}\\s+', '')"
    return x


def numerals(x: str, words: dict[str, str]) -> str:
    for w, d in words.items():
        x = f"regexp_replace({x}, '(?i)\\b{w}\\b', '{d}', 'g')"
    return x


def condo(x: str) -> str:
    from kindred.functions.text import CONDO, ONE_PREFIX

    inner = once(fold0(x), ONE_PREFIX[CONDO])
    return f"trim(regexp_replace(regexp_replace({inner}, '[|()/-]+', ' ', 'g'), ' +', ' ', 'g'))"


def district(x: str) -> str:
    from kindred.functions.text import DISTRICT, ONE_PREFIX

    return f"trim({once(fold0(x), ONE_PREFIX[DISTRICT])})"


def pairs(table: str, id_: str, name: str, block: str, forms: tuple[str, ...] = ("strip_accents(lower(name))",), threshold: float = 0.4, where: str = "true", source: str | None = None, classes: bool = False) -> str:
    """CTEs r, n, k, p: all pairs above the threshold by brute force over distinct names. classes: only the first record of a name meets other names and its copies."""
    grams = ", ".join(f"{tri(f)} AS g{k}" for k, f in enumerate(forms))
    score = ", ".join(jac(f"a.g{k}", f"b.g{k}") for k in range(len(forms)))
    score = f"greatest({score})" if len(forms) > 1 else score
    src = source or f"SELECT {id_} AS id, {name} AS name, {block} AS block, {block} AS parent FROM {table}"
    if classes:
        src, where = f"SELECT *, min(id) OVER (PARTITION BY block, name) AS head FROM ({src})", f"x.id = x.head AND (y.id = y.head OR x.name = y.name) AND {where}"
    return f"""r AS ({src}),
n AS (SELECT DISTINCT block, name FROM r WHERE block IS NOT NULL AND name IS NOT NULL),
f AS (SELECT block, name, {grams} FROM n),
k AS (SELECT a.block, a.name AS n1, b.name AS n2, {score} AS score FROM f AS a JOIN f AS b ON a.block = b.block),
p AS (SELECT x.id AS id_a, y.id AS id_b, x.name AS name_a, y.name AS name_b, CAST(x.parent AS VARCHAR) AS parent_id, k.score
      FROM r AS x JOIN r AS y ON x.block = y.block AND x.id < y.id JOIN k ON k.block = x.block AND k.n1 = x.name AND k.n2 = y.name
      WHERE k.score > {threshold} AND {where})"""


#: After the CTEs of pairs: each record, the least id of its name, and the number of its pairs.
LINKS = """, e AS (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p), c AS (SELECT id, count(*) AS links FROM e GROUP BY id)
SELECT r.id, min(r.id) OVER (PARTITION BY block, name) AS class_id, coalesce(links, 0) AS links FROM r LEFT JOIN c ON c.id = r.id WHERE block IS NOT NULL AND name IS NOT NULL"""


def components(edges: str, a: str = "id_a", b: str = "id_b") -> str:
    """Recursive CTEs up to c(node, root)."""
    return f"""sym AS (SELECT {a} AS u, {b} AS v FROM {edges} UNION SELECT {b}, {a} FROM {edges}),
walk AS (SELECT u AS node, u AS root FROM sym UNION SELECT sym.v, walk.root FROM walk JOIN sym ON sym.u = walk.node WHERE walk.root < sym.v),
c AS (SELECT node, min(root) AS root FROM walk GROUP BY node)"""
