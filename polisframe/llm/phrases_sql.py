"""The phrases as SQL, for the comparison."""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM runs, (SELECT unnest(range(1, 6)) AS k)),
counts AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE a >= 100),
parts AS (SELECT lang, a, words, size, unnest(range(1, k - size + 2)) AS i
          FROM frequent, (SELECT unnest(range(2, 5)) AS size) WHERE size < k),
inside AS (SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(a) AS most FROM parts GROUP BY ALL),
kept AS (SELECT f.* FROM frequent f LEFT JOIN inside USING (lang, phrase) WHERE k > 1 AND (most IS NULL OR most < a)),
cuts AS (SELECT lang, phrase, a, words, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n, ((1000 * c.a::HUGEINT * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1:len(c.words)], ' ') JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= 2000
"""
