"""Rules that read the text of one span: what must occur in it, how often, and what excuses it.

A rule names a scope, the patterns that a span must hold (each `least` times at least) and patterns
of which one occurrence makes it abstain. Evidence is the first few matches of the first pattern and
their number. All patterns of a scope are literals of one projection, evaluated in the JVM; nothing
is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_MATCHES, MOST_EXCERPT = 8, 240


class PatternRule(NamedTuple):
    name: str
    scope: str
    message: str
    needs: tuple[str, ...]
    unless: str | None = None
    least: int = 1

    @property
    def rule_id(self) -> str:
        return f"quill/{self.name}"


def _f(name: str, message: str, *needs: str, unless: str | None = None, least: int = 1) -> PatternRule:
    return PatternRule(name, "function", message, needs, unless, least)


def _c(name: str, message: str, *needs: str, unless: str | None = None) -> PatternRule:
    return PatternRule(name, "comment", message, needs, unless)


def _a(name: str, message: str, *needs: str, unless: str | None = None, least: int = 1) -> PatternRule:
    return PatternRule(name, "abstraction", message, needs, unless, least)


LOOP = r"\b(for|while)\s*\("
TEST = r"\b(it|test)\s*(\.\w+)?\s*\("
ASSERT = r"\b(expect|assert)\b"
CATCH = r"\bcatch\s*(\([^)]*\))?\s*\{"

PATTERN_RULES = (
    _f("accidental-serialization", "Independent awaits run one after another in a loop", LOOP, r"\bawait\b", unless=r"for\s+await"),
    _f("ad-hoc-branching", "Many unrelated decisions in one function", r"\b(if\s*\(|case\b|\?\s*[^.:?])", least=5),
    _f("adversarial-regex", "A nested repetition can take exponential time on hostile input", r"\([^()]*[+*]\)[+*]"),
    _f("ambient-dependency-grab", "A collaborator is fetched from a global accessor", r"\b[A-Z]\w*\.(getInstance|instance|current|shared|default)\b"),
    _f("any-widened-interface", "any reaches callers through the signature", r"[:<|&]\s*any\b"),
    _f("assertion-free-test", "The test asserts nothing", TEST, unless=ASSERT),
    _f("asymmetric-normalization", "Only one side of a comparison is normalised", r"\.(toLowerCase|toUpperCase|trim|normalize)\(\)\s*[!=]==?\s*[\w.]+(?!\w*\s*\.\s*(toLowerCase|toUpperCase|trim|normalize))"),
    _f("avoidable-orchestration", "Awaited steps might run together", r"\bawait\b", least=2, unless=r"Promise\.(all|allSettled)"),
    _f("bare-json-parse", "Input is parsed without a check of its shape", r"\bJSON\.parse\(", unless=r"\b(safeParse|schema|validate|assertIs)\w*|" + CATCH),
    _f("bespoke-crypto-construction", "A hand-made cipher or digest", r"(?i)function\s+\w*(hash|cipher|crypt|digest)\w*", r"(\^|<<|>>>?)"),
    _f("blocking-event-loop-call", "A synchronous call blocks the event loop", r"\b\w+Sync\("),
    _f("call-in-loop-persistence", "One persistence call for each item", LOOP + r"[\s\S]*?\bawait\s+[\w.]*(repo|repository|db|prisma|model|store)\w*\.\w+\("),
    _f("cascading-fallback", "A fallback that may fail as the first call did", CATCH + r"[^}]*\breturn\s+(await\s+)?\w*([Ff]allback|[Bb]ackup|[Ss]econdary)\w*"),
    _f("check-then-act-race", "A gap between a check and the act that relies on it", r"\bif\s*\(\s*!?\s*\(?await\b[^)]*\)[\s\S]*?\bawait\b", unless=r"(?i)\b(lock|transaction|mutex|upsert)\w*"),
    _f("clever-expression", "Dense expressions hide what happens", r"\bif\s*\([^=()]*[^=!<>]=[^=]|~~|!!\w+\s*\^|\w+\s*=\s*\w+\s*=\s*[^=]"),
    _f("client-only-authorization", "A role is checked on the client only", r"(?i)\b(user|session)\.(role|isAdmin|permissions)\b", r"<\w+"),
    _f("concurrent-shared-mutation", "Concurrent work writes a shared binding", r"Promise\.all\([\s\S]*?=>[\s\S]*?(\+=|\.push\(|\+\+)"),
    _f("console-residue", "Console output left in code", r"\b(console\.\w+\(|debugger\b)"),
    _f("construction-in-use", "A collaborator is built where it is used", r"\bnew\s+\w*(Client|Service|Repository|Gateway|Store)\("),
    _f("contextless-error", "An error says nothing of the values or the cause", r"throw\s+new\s+\w*Error\(\s*(['\"])[^'\"$]*\1\s*\)"),
    _f("coupled-index-collections", "Two collections are walked by one index", r"\b(\w+)\[(i|idx|index)\][\s\S]*?\b(?!\1\b)\w+\[\2\]", LOOP),
    _f("deep-happy-path-nesting", "The ordinary result lies deep inside conditions", r"\bif\s*\([^{]*\{[^}]*\bif\s*\([^{]*\{[^}]*\bif\s*\([^{]*\{[^}]*\breturn\b"),
    _f("deployment-coupled-assumption", "Where the code runs is written into it", r"(localhost|127\.0\.0\.1|0\.0\.0\.0|['\"]/(tmp|var|etc)/)", unless=r"process\.env"),
    _f("detached-async-work", "A promise is neither awaited nor handled", r"(?m)^\s*(void\s+)?\w*(save|send|publish|update|delete|fetch|load)\w*\([^;]*\);\s*$", r"\basync\b"),
    _f("disabled-tls-verification", "TLS verification is off", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED"),
    _f("discarded-transformation", "The result of a pure transform is thrown away", r"(?m)^\s*[\w.]+\.(map|filter|concat|slice|replace|trim|toUpperCase|toLowerCase)\([^;=]*\);\s*$"),
    _f("distrustful-type-guard", "A guard repeats what the type says", r"typeof\s+\w+\s*[!=]==?\s*['\"](string|number|boolean)['\"]", r"\(\s*\w+\s*:\s*(string|number|boolean)"),
    _f("double-negation", "Stacked negations", r"!\s*\(?\s*(is|has)?(Not|No|Non|Dis|Un)[A-Z]\w*|!\s*(not|no|non|dis)[A-Z]\w*|!\s*\(\s*!"),
    _f("dynamic-code-execution", "Text is run as code", r"\b(eval|new\s+Function|vm\.run\w*)\("),
    _f("english-only-pluralization", "Plurals are built for English only", r"===?\s*1\s*\?\s*['\"][^'\"]*['\"]\s*:\s*['\"][^'\"]*s['\"]"),
    _f("falsy-absent-conflation", "Zero or an empty text is taken as missing", r"\b(count|total|amount|price|index|length|size|offset|limit)\s*\|\|\s*[\w'\"]"),
    _f("flag-shepherded-control-flow", "A flag carries control from one place to another", r"\blet\s+(\w+)\s*=\s*(false|true)[\s\S]*?\b\1\s*=\s*(true|false)[\s\S]*?\bif\s*\(\s*!?\1\s*\)"),
    _f("flaky-order-assertion", "The order of concurrent work is asserted", TEST, r"Promise\.all", r"\.(toEqual|toStrictEqual)\(\s*\["),
    _f("floating-money-arithmetic", "Money in floating point", r"(?i)\b\w*(price|amount|total|cost|fee|tax|balance)\w*\s*[*/]\s*[\w.]+", unless=r"(?i)cents|minor|decimal|bigint"),
    _f("foreign-mutation", "Objects of another owner are changed", r"\.prototype\.\w+\s*=|Object\.assign\(\s*[A-Z]\w*\s*,"),
    _f("fs-recursive-reinvent", "Directories are walked by hand", r"\breaddir(Sync)?\(", r"\bisDirectory\(\)", unless=r"recursive\s*:\s*true"),
    _f("generic-magic", "Dynamic access hides what is used", r"\bnew\s+Proxy\(|\bReflect\.\w+\(|\bthis\[\w+\]"),
    _f("giant-test-arrange", "Much set-up before the first assertion", TEST, r"(?m)^\s*(const|let|await)\b", unless=None, least=8),
    _f("hand-rolled-csv-split", "Rows of CSV are split by hand", r"\.split\(\s*['\"]\\n['\"]\s*\)[\s\S]*?\.split\(\s*['\"],['\"]\s*\)"),
    _f("hand-rolled-date-format", "A date is put together from its parts", r"\.get(FullYear|Month|Date|Hours|Minutes)\(\)", least=2),
    _f("hand-rolled-debounce", "A timer wraps a call", r"\bclearTimeout\(", r"\bsetTimeout\(", r"return\s*(async\s*)?(function|\()"),
    _f("hand-rolled-deep-clone", "A clone by way of text", r"JSON\.parse\(\s*JSON\.stringify\("),
    _f("hand-rolled-deep-equal", "Structures are compared by hand", r"Object\.keys\([^)]*\)\.(length|every)[\s\S]*?Object\.keys\("),
    _f("hand-rolled-event-bus", "A registry of listeners by hand", r"\bemit\w*\(", r"\b(on|subscribe|addListener)\w*\(", r"new\s+Map\b|\{\s*\}"),
    _f("hand-rolled-flatten", "Arrays are flattened by hand", r"Array\.isArray\([^)]*\)[\s\S]*?\.\.\.|\breduce\([\s\S]*?\.concat\("),
    _f("hand-rolled-group-by", "Rows are grouped by hand", LOOP, r"\w+\[[^\]]+\]\s*(\?\?=|\|\|=|=\s*\w+\[[^\]]+\]\s*\|\|)"),
    _f("hand-rolled-number-format", "Numbers are formatted by hand", r"\\B\(\?=\(\\d\{3\}\)|['\"][$€£]['\"]\s*\+"),
    _f("hand-rolled-promise-timeout", "A timeout raced by hand", r"Promise\.race\(", r"setTimeout\("),
    _f("hand-rolled-relative-time", "Elapsed time is put into words by hand", r"\b(seconds?|minutes?|hours?|days?|weeks?)\b\s*ago", r"Date\.now\(\)"),
    _f("hand-rolled-retry-loop", "Retries by hand", LOOP, CATCH, r"\b(setTimeout|sleep|delay|wait)\w*\("),
    _f("hand-rolled-schema-check", "Fields are checked one by one", r"typeof\s+[\w.]+\s*[!=]==?\s*['\"]", least=3),
    _f("hand-rolled-set-ops", "Set operations by loops", r"\.(includes|indexOf)\(", LOOP + r"|\.filter\(", r"\.push\(|\.filter\("),
    _f("hand-rolled-string-hash", "A text hash by hand", r"\.charCodeAt\(", r"(<<|\*\s*31|\^)"),
    _f("hand-rolled-url-query", "Query strings by split and join", r"\.split\(\s*['\"][&?=]['\"]\s*\)|\+\s*['\"][&?]\w*="),
    _f("hand-rolled-uuid", "Random ids by hand", r"Math\.random\(\)\.toString\(\s*(16|36)\s*\)|xxxxxxxx-xxxx"),
    _f("hidden-input-mutation", "An argument is changed", r"\(\s*(\w+)\s*[:,)][\s\S]*?\b\1\.(push|splice|sort|reverse|shift|unshift|pop)\("),
    _f("hidden-loop-exit", "Exits in the middle of a loop", LOOP, r"\b(break|continue|return)\b", least=2),
    _f("hidden-partial-failure", "Some of a batch may have failed unseen", r"Promise\.allSettled\(", unless=r"['\"](rejected|fulfilled)['\"]"),
    _f("hidden-runtime-input", "Clock, chance or environment is read inside", r"\b(Date\.now\(\)|new\s+Date\(\)|Math\.random\(\)|process\.env)"),
    _f("implementation-named-test", "The title repeats a function's name", TEST.replace(r"\s*\(", r"\s*\(\s*['\"]\w+\(?\)?['\"]")),
    _f("incidental-snapshot", "A snapshot stands for an outcome", TEST, r"\.toMatch(Inline)?Snapshot\("),
    _f("indiscriminable-error", "Different failures look alike", r"throw\s+new\s+Error\(", least=3),
    _f("interaction-pinning-test", "Calls are asserted instead of outcomes", TEST, r"\.toHaveBeenCalled\w*\("),
    _f("laundered-absence", "Missing data turns into an ordinary value", r"(\?\?|\|\|)\s*(0|''|\"\"|\[\]|\{\})"),
    _f("load-bearing-async", "An async function that awaits nothing", r"\basync\b", unless=r"\bawait\b"),
    _f("locale-blind-ordering", "Text is ordered without a locale", r"\.sort\(\s*\)|\.sort\([^)]*=>[^)]*[<>]", unless=r"localeCompare|Intl\."),
    _f("locale-date-serialization", "A localised date is stored or sent", r"\.toLocale(Date|Time)?String\(", r"(?i)(JSON\.stringify|\.save|\.set|\.send|fetch)\w*\("),
    _f("log-and-propagate", "An error is both logged and thrown on", CATCH + r"[^}]*\b(console|log|logger)\.\w+\([^}]*\bthrow\b"),
    _f("logic-in-test", "Branches or loops in a test", TEST, r"\b(if|for|while|switch)\s*\("),
    _f("lossy-error-translation", "The cause of an error is lost", CATCH + r"[^}]*throw\s+new\s+\w+\((?![^)]*\b(cause|err|error|e)\b)"),
    _f("lossy-sentinel-return", "Special values stand for failures", r"\breturn\s+(null|undefined|-1|false)\s*;", least=2),
    _f("message-chain", "A long chain of navigation", r"\w+(\.\w+(\([^()]*\))?){4,}", least=1),
    _f("missing-shutdown-drain", "A server stops without draining", r"\.listen\(", unless=r"SIGTERM|SIGINT"),
    _f("mixed-absence-convention", "Both null and undefined mean absence", r"\bnull\b", r"\bundefined\b"),
    _f("mock-everything", "Doubles outnumber outcomes", TEST, r"\b(vi|jest)\.(fn|mock|spyOn)\(", least=4),
    _f("mode-flag-parameter", "A flag chooses between two functions in one", r"\(\s*[^)]*\b\w+\s*:\s*boolean[^)]*\)", r"\bif\s*\(\s*!?\w+\s*\)[\s\S]*?\belse\b"),
    _f("negative-boolean-name", "A negated name", r"\b(const|let|var)\s+(is|has|should)?(Not|No|Disable|Without)\w*|\b(is|has|should)Not[A-Z]\w*"),
    _f("nested-conditional-expression", "Conditional expressions inside each other", r"\?[^?:;.]+:[^?:;]+\?[^?:;.]+:"),
    _f("non-idempotent-retry", "An effect is retried without a key", r"(?i)retr(y|ies)", r"(?i)\b(charge|create|send|post|insert|publish)\w*\(", unless=r"(?i)idempoten"),
    _f("nondeterministic-test-input", "A test that depends on chance or the clock", TEST, r"Math\.random\(\)|Date\.now\(\)|new\s+Date\(\)", unless=r"(?i)useFakeTimers|seed"),
    _f("offset-pagination-drift", "Pages shift without a stable order", r"(?i)\b(offset|skip)\b", unless=r"(?i)order\s*by|orderBy|sort"),
    _f("orphaned-timer", "A repeating timer is never cleared", r"\bsetInterval\(", unless=r"\bclearInterval\("),
    _f("overbroad-origin-trust", "Any origin is trusted", r"(?i)(access-control-allow-origin|origin)['\"]?\s*[:,]\s*['\"]\*['\"]|postMessage\([^)]*,\s*['\"]\*['\"]"),
    _f("overloaded-boolean-return", "One boolean, several reasons", r"\breturn\s+(true|false)\s*;", least=3),
    _f("partially-narrowed-nullable", "Only one of null and undefined is ruled out", r"[!=]==\s*(null|undefined)\b", unless=r"[^!=]!=\s*null|===?\s*null[\s\S]*===?\s*undefined|\?\?"),
    _f("pass-through-wrapper", "The body only forwards", r"^[^{]*\{\s*return\s+(await\s+)?[\w.]+\([\w\s,.]*\);?\s*\}\s*;?\s*$"),
    _f("path-traversal-join", "A path from input", r"\b(path\.)?(join|resolve)\([^)]*\b(req|request|params|query|body|input|name|file\w*)\b"),
    _f("predicate-name-deception", "A predicate that returns no boolean", r"\bfunction\s+(is|has|can|should)[A-Z]\w*\([^)]*\)\s*:\s*(?!boolean|\w+\s+is\b|asserts|Promise<boolean>)\w+"),
    _f("predictable-token", "A secret from plain chance", r"(?i)(token|secret|password|key|nonce|session)\w*\s*=[^;]*Math\.random"),
    _f("private-internals-assertion", "A test of internals", TEST, r"\bas\s+any\)\.|\[['\"]_\w+['\"]\]|\._\w+"),
    _f("prototype-in-production", "Marked as unfinished", r"(?i)\b(hack|temporary|proof of concept|prototype only|quick fix|not production)\b"),
    _f("quarantined-test-coverage", "A skipped test", r"\b(it|test|describe)\.(skip|todo)\(|\b(xit|xdescribe|xtest)\("),
    _f("query-side-effect", "A query that also commands", r"\bfunction\s+(get|find|fetch|is|has|compute)\w*", r"\b\w+\.(set|delete|push|save|update|write)\w*\("),
    _f("redundant-conditional-arm", "Both arms are the same", r"\?\s*([\w.'\"()]+)\s*:\s*\1\s*[;,)]|\bif\s*\([^)]*\)\s*\{([^{}]*)\}\s*else\s*\{\2\}"),
    _f("sensitive-data-in-log", "A secret is logged", r"(?i)\b(console|log|logger)\.\w+\([^)]*\b\w*(password|secret|token|apiKey|ssn|creditCard)\w*"),
    _f("side-effecting-conditional-expression", "An expression used for its effect", r"(?m)^\s*[\w.!]+\s*(&&|\|\|)\s*[\w.]+\([^;]*\);\s*$"),
    _f("silent-queue-drop", "A full queue goes unnoticed", r"(?m)^\s*[\w.]*([qQ]ueue|[sS]tream|[cC]hannel)\.(write|push|offer|sendToQueue)\([^;]*\);\s*$"),
    _f("sleep-in-test", "A fixed sleep in a test", TEST, r"\b(setTimeout|sleep|delay)\w*\("),
    _f("stale-feature-flag", "A flag that may be settled", r"(?i)\b(is)?feature(Flag|Enabled|s)?\w*[.(]|\bflags?\.\w+"),
    _f("swallowed-error", "An error disappears", CATCH + r"\s*(//[^\n]*\s*)?\}"),
    _f("table-shaped-conditional", "Branches that are data", r"\bcase\s+[^:]+:\s*return\s+[\w'\".]+\s*;", least=3),
    _f("tautological-test", "The expectation repeats the subject", TEST, r"expect\(\s*([\w.()]+)\s*\)\.\w+\(\s*\1\s*\)"),
    _f("timezone-naive-arithmetic", "Days counted in milliseconds", r"86_?400_?000|24\s*\*\s*60\s*\*\s*60|\.setDate\(\s*\w+\.getDate\(\)"),
    _f("truncating-numeric-parse", "A lenient parse of numbers", r"\b(parseInt|parseFloat)\(", unless=r"isNaN|isFinite|isInteger"),
    _f("type-checker-escape", "The type checker is overruled", r"\bas\s+(any|unknown\s+as)\b|<any>"),
    _f("type-code-dispatch", "A switch on a type code", r"\bswitch\s*\([^)]*\b(type|kind|code|tag)\b\s*\)"),
    _f("unanchored-domain-check", "A host is checked by part of its name", r"(?i)\b(url|host|origin|domain|href)\w*\.(includes|indexOf|endsWith|startsWith)\(\s*['\"]"),
    _f("unawaited-iteration-work", "Async work that the loop does not await", r"\.forEach\(\s*async\b"),
    _f("unbounded-parallel-fanout", "As many calls at once as there are items", r"Promise\.all\(\s*\w+\.map\(", unless=r"(?i)limit|pool|chunk|batch"),
    _f("unbounded-wait", "A call without a time limit", r"\bawait\s+(fetch|axios(\.\w+)?|got|request)\(", unless=r"(?i)timeout|AbortSignal|signal"),
    _f("unclosed-handle", "A handle stays open on some path", r"\b(open|createReadStream|createConnection|connect|acquire)\(", unless=r"\b(close|release|end|destroy|dispose|finally|using)\b"),
    _f("unexplained-complex-condition", "A condition of many parts", r"\bif\s*\((?:[^()]|\([^()]*\))*(&&|\|\|)(?:[^()]|\([^()]*\))*(&&|\|\|)(?:[^()]|\([^()]*\))*(&&|\|\|)"),
    _f("unexplained-domain-threshold", "A bare threshold", r"[<>]=?\s*\d{2,}(?!\s*[*/])"),
    _f("unguarded-nullable-dereference", "A lookup is used unchecked", r"\.(find|match|get|exec)\([^()]*(\([^()]*\))?[^()]*\)\.\w+"),
    _f("unit-scale-mismatch", "A factor at odds with the name's unit", r"(?i)\b\w*(seconds|secs)\b\s*[*]\s*(60|24)\b|\b\w*(ms|millis)\b\s*\*\s*1000"),
    _f("unitless-quantity", "A quantity without its unit", r"(?i)\b(timeout|delay|interval|ttl|duration|size|distance)\s*[:=]\s*\d+"),
    _f("unlabeled-interactive-element", "An element without a name", r"<(button|input|a)\b(?![^>]*(aria-label|title|id)=)[^>]*/>"),
    _f("unlocalized-user-string", "A user's text is not translated", r">\s*[A-Z][a-z]+(\s+[a-z]+)+\s*<", unless=r"\bt\("),
    _f("unreleased-subscription", "A listener is never removed", r"\b(addEventListener|subscribe)\(", unless=r"\b(removeEventListener|unsubscribe|AbortSignal|signal)\b"),
    _f("unsafe-redirect-target", "A redirect that input decides", r"\b(redirect|location\.(href|assign|replace))\b[^;]*\b(req|request|query|params|searchParams)\b"),
    _f("unsafe-retry", "Retries without wait or end", r"(?i)retr(y|ies)", LOOP, unless=r"(?i)backoff|delay|sleep|max"),
    _f("untrusted-sink-input", "Input reaches a query, page or command", r"\b(query|exec|execute|execSync|raw)\(\s*[`'\"][^)]*(\$\{|['\"`]\s*\+)|\.innerHTML\s*="),
    _f("unvalidated-boundary-shape", "Outside data is used as it comes", r"\bawait\s+\w+\.json\(\)|\breq\.body\b", unless=r"(?i)parse\(|schema|validate|zod"),
    _f("unwieldy-signature", "Too many parameters", r"\(\s*(?:[\w$]+\s*[?]?\s*(?::[^,()]+)?,\s*){5,}[\w$]+"),
    _f("verbless-function-name", "A function with effects that names no action", r"\bfunction\s+(data|info|handler|manager|processor|helper|util|thing)\w*\s*\("),
    _f("weak-crypto-primitive", "A weak digest or cipher", r"(?i)create(Hash|Cipheriv|Hmac)\(\s*['\"](md5|sha1|des|rc4)"),
    _c("commented-out-implementation", "Code in a comment", r"(?m)^\s*(//|\*)\s*(const|let|var|return|if\s*\(|for\s*\(|function\b|\w+\([^)]*\);|\})"),
    _c("confusion-confessing-comment", "The author was not sure", r"(?i)\b(not sure|no idea|don't know why|somehow|magic|for some reason|weird)\b"),
    _c("unenforced-warning-comment", "A warning that nothing enforces", r"(?i)\b(do not|don't|never|must not|warning|careful|beware)\b"),
    _c("unexplained-suppression", "A check is silenced without a reason", r"(eslint-disable\S*|@ts-(ignore|expect-error|nocheck)|prettier-ignore|biome-ignore)\s*(?:[\w/-]+)?\s*$"),
    _c("unverified-claim", "A claim without evidence", r"(?i)\b(always|guaranteed|thread.safe|cannot fail|faster|optimi[sz]ed|constant time)\b"),
    _c("unaccountable-todo", "Work left to no one", r"\b(TODO|FIXME|XXX)\b", unless=r"(TODO|FIXME|XXX)\s*\([^)]+\)|#\d+|[A-Z]{2,}-\d+"),
    _c("narrating-comment", "A comment that repeats the code", r"(?i)^\s*//\s*(increment|set|get|return|loop|call|create|initiali[sz]e|check)s?\s+(the\s+)?\w+\s*$"),
    _a("boolean-fanout", "Several booleans for one state", r"\b(is|has|can|should)\w+\s*[?]?\s*:\s*boolean", least=3),
    _a("conditionally-valid-state", "Fields that count in some states only", r"\b(kind|type|status|state)\s*:\s*['\"]?", r"\w+\?\s*:"),
    _a("content-free-nominal", "A name that says nothing", r"\b(class|interface|type)\s+\w*(Manager|Helper|Utils?|Processor|Handler|Data|Info)\b"),
    _a("correlated-state-booleans", "Booleans that exclude each other", r"\b(is)?(Loading|Success|Error|Idle|Pending|Done|Failed)\w*\s*[?]?\s*:\s*boolean|\bis[A-Z]\w*(ing|ed)\s*:\s*boolean", least=2),
    _a("disproportionate-configuration", "Many options", r"\w+\?\s*:", least=8),
    _a("standard-method-synonym", "Several verbs for one action", r"\b(get|fetch|load|retrieve|find)[A-Z]\w*\s*\(", least=3),
    _a("temporary-field", "A field for one method's sake", r"\b(private\s+)?(temp|tmp|current|last)\w*\s*[?]?\s*[:=]"),
    _a("unconstrained-state-string", "A state kept as any text", r"\b(status|state|phase|mode|stage)\s*[?]?\s*:\s*string\b"),
    _a("verb-named-field", "A field named as an action", r"\b(get|fetch|load|save|send|create|delete)[A-Z]?\w*\s*[?]?\s*:\s*(string|number|boolean)\b"),
)


def evidence_of(text: Column, rule: PatternRule) -> Column:
    """A struct of rule_id, matches and total, null if the rule abstains."""
    found = F.regexp_extract_all(text, F.lit(rule.needs[-1] if len(rule.needs) > 1 and rule.least > 1 else rule.needs[0]), F.lit(0))
    holds = F.size(found) >= rule.least
    for pattern in rule.needs:
        holds = holds & text.rlike(pattern)
    if rule.unless:
        holds = holds & ~text.rlike(rule.unless)
    matches = F.transform(F.slice(found, 1, MOST_MATCHES), lambda m: F.substring(m, 1, MOST_EXCERPT))
    return F.when(holds, F.struct(F.lit(rule.rule_id).alias("rule_id"), matches.alias("matches"), F.size(found).alias("total")))


def pattern_evidence(spans: DataFrame, text: str = "text", keep: tuple[str, ...] = ("file_path", "id", "kind"), rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """(…keep, rule_id, matches, total) for each span (with kind and text) and each rule that it does not abstain from."""
    scopes = list(dict.fromkeys(r.scope for r in rules))
    empty = F.array().cast("array<struct<rule_id:string,matches:array<string>,total:int>>")
    answers = empty
    for scope in scopes:
        own = F.array_compact(F.array(*[evidence_of(F.col(text), r) for r in rules if r.scope == scope]))
        answers = F.when(F.col("kind") == scope, own).otherwise(answers)
    return spans.select(*keep, F.explode(answers).alias("e")).select(*keep, "e.*")


def span_texts(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the text of their lines."""
    source = files.select(F.col("file_path").alias("_f"), F.split("source", "\n").alias("_lines"))
    met = candidates.join(source, F.col("file_path") == F.col("_f"))
    cut = F.slice("_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return met.withColumn("text", F.array_join(cut, "\n")).drop("_f", "_lines")
