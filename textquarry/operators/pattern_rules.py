"""The catalogue of design-pattern rules for source files.

Fixed values: patterns, languages, expressions and weights, in catalogue order. Rules are matched line by line; expressions that could only match
across a line break are left out, since they can never hold.
"""

from __future__ import annotations

from textquarry.operators.rules import PathRule, Rule

PY, JV, CPP = ("python",), ("java",), ("cpp",)
JS, JSX, JVC = ("javascript", "typescript"), ("javascript", "typescript", "jsx"), ("java", "cpp")

CATEGORIES = {
    "Singleton": "creational", "Factory": "creational", "Decorator": "structural", "Observer": "behavioral", "Strategy": "behavioral", "State": "behavioral", "Adapter": "structural", "Repository": "architectural",
    "Middleware": "architectural", "ErrorHandling": "reliability", "Concurrency": "concurrency", "DependencyInjection": "architectural", "MVC": "architectural", "TemplateMethod": "behavioral",
    "ChainOfResponsibility": "behavioral", "Bridge": "structural", "Facade": "structural",
}

_LINES = [
    ("Singleton", PY, r"def\s+__new__\s*\(", 0.9),
    ("Singleton", PY, r"_instance\s*=\s*None", 0.85),
    ("Singleton", PY, r"def\s+(get_instance|getInstance|instance)\s*\(", 0.9),
    ("Singleton", PY, r"cls\._instance\s+is\s+None", 0.85),
    ("Singleton", JVC, r"static.*getInstance\s*\(|getInstance\s*\(\)", 0.9),
    ("Singleton", JVC, r"private\s+static", 0.7),
    ("Singleton", JSX, r"getInstance\s*\(|_instance\s*=|static\s+instance\b", 0.85),
    ("Factory", PY, r"class\s+\w*[Ff]actory\w*\s*[\(:]", 0.9),
    ("Factory", PY, r"def\s+create_\w+|def\s+make_\w+", 0.8),
    ("Factory", JVC, r"class\s+\w*[Ff]actory", 0.9),
    ("Factory", JVC, r"(static\s+\w+\s+create\w*|createInstance)\s*\(", 0.85),
    ("Factory", JSX, r"[Ff]actory\s*[\({]|factory\s*=\s*function|createFactory", 0.85),
    ("Decorator", PY, r"functools\.wraps|@functools\.wraps", 0.95),
    ("Decorator", PY, r"def\s+\w+\s*\(\s*func\s*\)", 0.8),
    ("Decorator", PY, r"return\s+wrapper", 0.75),
    ("Decorator", JS, r"function\s+\w+\s*\(fn\s*\)", 0.85),
    ("Decorator", JV, r"@Override|@\w+\s*\(", 0.7),
    ("Observer", PY, r"def\s+(subscribe|unsubscribe|add_listener|remove_listener)\s*\(", 0.9),
    ("Observer", PY, r"def\s+(notify|notify_all|emit|dispatch)\s*\(", 0.9),
    ("Observer", PY, r"(self\.listeners|self\.observers|self\._subscribers|self\.handlers)\s*=\s*\[", 0.85),
    ("Observer", PY, r"for\s+\w+\s+in\s+self\.(listeners|observers|handlers|callbacks)", 0.8),
    ("Observer", JSX, r"addEventListener|removeEventListener|\.on\s*\(|\.emit\s*\(", 0.85),
    ("Observer", JSX, r"subscribe\s*\(|unsubscribe\s*\(", 0.85),
    ("Observer", JV, r"Observer|EventListener|addObserver|removeObserver", 0.9),
    ("Strategy", PY, r"class\s+\w*[Ss]trategy\w*\s*[\(:]", 0.9),
    ("Strategy", PY, r"self\._strategy\s*=|self\.strategy\s*=", 0.85),
    ("Strategy", PY, r"self\.strategy\.\w+\s*\(|self\._strategy\.\w+\s*\(", 0.85),
    ("Strategy", PY, r"def\s+set_strategy\s*\(", 0.85),
    ("Strategy", JV, r"(Strategy|strategy)\s+\w+|implements.*Strategy", 0.85),
    ("State", PY, r"class\s+\w*[Ss]tate\w*\s*[\(:]", 0.85),
    ("State", PY, r"def\s+(transition_to|change_state|set_state)\s*\(", 0.9),
    ("State", PY, r"self\._state\s*=|self\.state\s*=\s*\w+State", 0.8),
    ("State", PY, r"def\s+handle\s*\(self.*context", 0.8),
    ("State", JV, r"State|setState|getState", 0.8),
    ("Adapter", PY, r"class\s+\w*[Aa]dapter\w*\s*[\(:]", 0.9),
    ("Adapter", PY, r"self\.(adaptee|_wrapped|_target|wrapped)\s*=", 0.85),
    ("Adapter", JV, r"[Aa]dapter\b|implements.*Adapter", 0.85),
    ("Repository", PY, r"class\s+\w*(Repository|Repo|DAO)\w*\s*[\(:]", 0.9),
    ("Repository", PY, r"def\s+(find_by_id|find_all|find_by|get_by_id|get_all|save|delete|update)\s*\(", 0.8),
    ("Repository", PY, r"(session|db|connection)\.query|\.filter\s*\(", 0.75),
    ("Repository", JV, r"@Repository|CrudRepository|JpaRepository|extends.*Repository", 0.95),
    ("Middleware", PY, r"class\s+\w*[Mm]iddleware\w*\s*[\(:]", 0.9),
    ("Middleware", PY, r"def\s+__call__\s*\(self,\s*(request|environ|scope)", 0.9),
    ("Middleware", PY, r"def\s+(process_request|before_request|after_request)\s*\(", 0.85),
    ("Middleware", PY, r"(next|get_response)\s*\(.*request", 0.85),
    ("Middleware", JS, r"app\.use\s*\(|router\.use\s*\(", 0.85),
    ("Middleware", JS, r"\(req,\s*res,\s*next\)|function\s*\(req,\s*res,\s*next\)", 0.9),
    ("ErrorHandling", PY, r"class\s+\w*(Error|Exception)\s*\(", 0.9),
    ("ErrorHandling", PY, r"except\s+\w+(Error|Exception)\s+as", 0.8),
    ("ErrorHandling", PY, r"finally\s*:", 0.75),
    ("ErrorHandling", PY, r"raise\s+\w*(Error|Exception)\s*\(", 0.8),
    ("ErrorHandling", JV, r"catch\s*\(\s*\w+(Exception|Error)\s+\w+\s*\)", 0.8),
    ("ErrorHandling", JV, r"class\s+\w+(Exception|Error)\s+extends", 0.9),
    ("ErrorHandling", CPP, r"catch\s*\(.*\)|throw\s+std::", 0.85),
    ("ErrorHandling", JS, r"catch\s*\(\s*\w+\s*\)\s*\{|\.catch\s*\(", 0.8),
    ("ErrorHandling", JS, r"class\s+\w+(Error|Exception)\s+extends", 0.9),
    ("Concurrency", PY, r"^async\s+def\s+", 0.9),
    ("Concurrency", PY, r"\bawait\s+", 0.85),
    ("Concurrency", PY, r"import\s+asyncio|from\s+asyncio", 0.85),
    ("Concurrency", PY, r"threading\.Thread|from\s+threading\s+import|asyncio\.Lock", 0.85),
    ("Concurrency", JV, r"synchronized\s*\(|volatile\s+|ExecutorService|CompletableFuture", 0.9),
    ("Concurrency", CPP, r"std::thread|std::mutex|std::lock|std::async", 0.9),
    ("Concurrency", JS, r"async\s+function|async\s*\(", 0.85),
    ("Concurrency", JS, r"new\s+Promise\s*\(|Promise\.all|Promise\.race", 0.8),
    ("DependencyInjection", PY, r"@inject|from\s+(injector|dependency_injector|wire|inject)\s+import", 0.95),
    ("DependencyInjection", PY, r"def\s+__init__\s*\(self,\s*\w+:\s*[A-Z][A-Za-z]+[A-Za-z]*\s*[,\)]", 0.75),
    ("DependencyInjection", PY, r"@Provide|@Singleton|@Module", 0.9),
    ("DependencyInjection", JV, r"@Inject|@Autowired|@Component|@Service|@Bean", 0.95),
    ("MVC", PY, r"@app\.route|@router\.(get|post|put|delete|patch)\s*\(|@blueprint\.", 0.85),
    ("MVC", PY, r"class\s+\w*(Model|View|Controller|ViewSet|Serializer)\s*[\(:]", 0.8),
    ("MVC", PY, r"render_template|HttpResponse|JSONResponse|TemplateResponse", 0.75),
    ("MVC", JS, r"router\.(get|post|put|delete)\s*\(|express\.Router", 0.85),
    ("TemplateMethod", PY, r"from\s+abc\s+import.*ABC|import\s+abc", 0.75),
    ("TemplateMethod", PY, r"@abstractmethod", 0.9),
    ("TemplateMethod", PY, r"class\s+\w+\s*\(.*ABC.*\)|class\s+\w+\s*\(.*Abstract", 0.85),
    ("TemplateMethod", JV, r"abstract\s+class|abstract\s+\w+\s+\w+\s*\(", 0.9),
    ("ChainOfResponsibility", PY, r"self\.(next_handler|successor|next)\s*=", 0.9),
    ("ChainOfResponsibility", PY, r"class\s+\w*(Handler|Chain)\w*\s*[\(:]", 0.8),
    ("ChainOfResponsibility", JV, r"Handler|setNext\s*\(|setSuccessor\s*\(", 0.85),
    ("Bridge", PY, r"self\.(implementation|implementor|_impl)\s*=", 0.9),
    ("Bridge", PY, r"class\s+\w*(Abstraction|Implementor|Bridge)\w*\s*[\(:]", 0.85),
    ("Bridge", JV, r"Implementor|ConcreteImplementor", 0.85),
    ("Facade", PY, r"class\s+\w*[Ff]acade\w*\s*[\(:]", 0.9),
    ("Facade", JV, r"[Ff]acade\b", 0.85),
]
RULES = [Rule(p, f"{p.lower()}_{i}", regex, weight, languages, CATEGORIES[p]) for i, (p, languages, regex, weight) in enumerate(_LINES)]
# a nested wrapper is shown with the three lines after it; subsystem objects count from the third on
RULES.append(Rule("Decorator", "decorator_wrapper", r"def\s+wrapper\s*\(", 0.85, PY, "structural", after=3))
RULES.append(Rule("Facade", "facade_delegates", r"self\.\w+\s*=\s*\w+\(\)", 0.5, PY, "structural", at_least=3))

PATH_RULES = [
    PathRule("Factory", 0.7, names=("factory",), languages=PY),
    PathRule("Adapter", 0.7, names=("adapter",), languages=PY),
    PathRule("Repository", 0.7, names=("repository", "repo", "dao"), languages=PY),
    PathRule("Middleware", 0.7, names=("middleware",), languages=PY),
    PathRule("Facade", 0.7, names=("facade",), languages=PY),
    PathRule("MVC", 0.8, folders=("models", "views", "controllers", "templates")),
]
