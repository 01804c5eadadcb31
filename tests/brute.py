"""Plain-Python restatement of what a scan must find, one file at a time, for checking the Spark plans."""

import re

from scanloom.fixed_values import LANGUAGE_KEYS


def compiled(pattern, flags):
    try:
        return re.compile(pattern, flags)
    except re.error:
        return None


def rules_for(language, rules):
    names = set(LANGUAGE_KEYS.get(language, []))
    return [r for r in rules if names.intersection(r.languages)]


def single_findings(lines, rules):
    for number, line in enumerate(lines, 1):
        for rule in rules:
            flags = re.IGNORECASE if rule.ignore_case else 0
            hit = next((i for i, p in enumerate(rule.patterns)
                        if (c := compiled(p, flags)) and c.search(line)), None)
            if hit is not None:
                around = "\n".join(lines[max(number - 3, 0):number + 2])
                yield rule, hit, number, around


def spans(content, pattern):
    regex = compiled(pattern, re.IGNORECASE | re.DOTALL)
    for m in regex.finditer(content) if regex else ():
        if m.group().strip():
            yield content.count("\n", 0, m.start()) + 1, content.count("\n", 0, m.end()) + 1


def multi_findings(content, lines, rules, singles):
    found = [(r.id, first, r.ord, i, k, last, r)
             for r in rules for i, p in enumerate(r.multi_line_patterns)
             for k, (first, last) in enumerate(spans(content, p))]
    kept, last_kept = [], {}
    for row in sorted(found, key=lambda x: x[:5]):
        rule_id, first, last = row[0], row[1], row[5]
        if rule_id not in last_kept or first - last_kept[rule_id] > 3:
            last_kept[rule_id] = last
            kept.append(row)
    latest = {(r.id, r.patterns[i]): number for r, i, number, _ in singles}
    for rule_id, first, _, i, _, last, rule in kept:
        if latest.get((rule_id, rule.multi_line_patterns[i])) != first:
            yield rule, i, first, last, "\n".join(lines[max(first - 2, 0):last + 1])


def scan(content, language, rules, multi_line=True):
    """Set of (rule_id, rule_ord, pattern_idx, line, line_end, match_type, snippet)."""
    lines = content.split("\n")
    rules = rules_for(language, rules)
    singles = list(single_findings(lines, rules))
    out = [(r.id, r.ord, i, n, None, "single-line", around) for r, i, n, around in singles]
    if multi_line:
        out += [(r.id, r.ord, i, a, b, "multi-line", around)
                for r, i, a, b, around in multi_findings(content, lines, rules, singles)]
    return sorted(out, key=repr)
