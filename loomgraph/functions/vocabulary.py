"""Fixed values of the data model: types, categories, aliases, weights, patterns.

Every table below is part of the model that results must equal; none is derived.
"""

from __future__ import annotations

# fixed values: node types by family
NODE_TYPES = {
    "code": ["file", "function", "class", "module", "concept"],
    "non-code": ["config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource"],
    "domain": ["domain", "flow", "step"],
    "knowledge": ["article", "entity", "topic", "claim", "source"],
    "design": ["page", "screen", "component", "componentSet", "instance", "token"],
}
# fixed values: edge types by filter category
EDGE_CATEGORIES = {
    "structural": ["imports", "exports", "contains", "inherits", "implements"],
    "behavioral": ["calls", "subscribes", "publishes", "middleware"],
    "data-flow": ["reads_from", "writes_to", "transforms", "validates"],
    "dependencies": ["depends_on", "tested_by", "configures"],
    "semantic": ["related", "similar_to"],
    "infrastructure": ["deploys", "serves", "provisions", "triggers", "migrates", "documents", "routes", "defines_schema"],
    "domain": ["contains_flow", "flow_step", "cross_domain"],
    "knowledge": ["cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by"],
    "design": ["instance_of", "variant_of", "uses_token"],
}
# fixed values: node types by filter category; all others are "code"
NODE_CATEGORIES = {
    "config": ["config"],
    "docs": ["document"],
    "infra": ["service", "resource", "pipeline"],
    "data": ["table", "endpoint", "schema"],
    "domain": ["domain", "flow", "step"],
    "knowledge": ["article", "entity", "topic", "claim", "source"],
}
# fixed values: aliases of node types, in all graphs, in design graphs and in all others
NODE_ALIASES = {
    "function": ["func", "fn", "method"],
    "class": ["interface", "struct"],
    "module": ["mod", "pkg", "package"],
    "service": ["container", "deployment", "pod"],
    "document": ["doc", "readme", "docs"],
    "pipeline": ["job", "ci"],
    "endpoint": ["route", "api", "query", "mutation"],
    "config": ["setting", "env", "configuration"],
    "resource": ["infra", "infrastructure", "terraform"],
    "table": ["migration", "database", "db", "view"],
    "schema": ["proto", "protobuf", "definition", "typedef"],
    "domain": ["business_domain"],
    "flow": ["business_flow", "business_process"],
    "step": ["task", "business_step"],
    "article": ["note", "wiki_page"],
    "entity": ["person", "actor", "organization"],
    "topic": ["tag", "category", "theme"],
    "claim": ["assertion", "decision", "thesis"],
    "source": ["reference", "raw", "paper"],
}
DESIGN_NODE_ALIASES = {"screen": ["frame", "artboard"], "page": ["canvas"], "component": ["main_component"], "componentSet": ["component_set", "variant_set", "componentset"], "token": ["design_token", "style"]}
OTHER_NODE_ALIASES = {"article": ["page"]}
# fixed values: aliases of edge types, likewise
EDGE_ALIASES = {
    "inherits": ["extends"],
    "calls": ["invokes", "invoke"],
    "depends_on": ["uses", "requires"],
    "related": ["relates_to", "related_to"],
    "similar_to": ["similar"],
    "imports": ["import"],
    "exports": ["export"],
    "contains": ["contain"],
    "publishes": ["publish"],
    "subscribes": ["subscribe"],
    "documents": ["describes", "documented_by"],
    "provisions": ["creates"],
    "serves": ["exposes", "listens"],
    "deploys": ["deploys_to"],
    "migrates": ["migrates_to"],
    "routes": ["routes_to"],
    "triggers": ["triggers_on", "fires"],
    "defines_schema": ["defines"],
    "contains_flow": ["has_flow"],
    "flow_step": ["next_step"],
    "cross_domain": ["interacts_with"],
    "cites": ["references", "cites_source"],
    "contradicts": ["conflicts_with", "disagrees_with"],
    "builds_on": ["refines", "elaborates"],
    "exemplifies": ["illustrates", "example_of"],
    "categorized_under": ["belongs_to", "tagged_with"],
    "authored_by": ["written_by", "created_by"],
}
DESIGN_EDGE_ALIASES = {"instance_of": ["instantiates"], "variant_of": ["variant"], "uses_token": ["styled_by", "applies_token"]}
OTHER_EDGE_ALIASES = {"exemplifies": ["instance_of"]}
# fixed values: complexity and direction
COMPLEXITIES = ["simple", "moderate", "complex"]
COMPLEXITY_ALIASES = {"simple": ["low", "easy"], "moderate": ["medium", "intermediate"], "complex": ["high", "hard", "difficult"]}
DIRECTION_ALIASES = {"forward": ["to", "outbound"], "backward": ["from", "inbound"], "bidirectional": ["both", "mutual"]}
# fixed values: an edge's weight where none is given; all others 0.5
EDGE_WEIGHTS = {
    1.0: ["contains"],
    0.9: ["inherits", "implements"],
    0.8: ["calls", "exports", "defines_schema"],
    0.7: ["imports", "deploys", "migrates"],
    0.6: ["depends_on", "configures", "triggers"],
}
# fixed values: layers by path segments, in order of priority
LAYER_PATTERNS = {
    "API Layer": ["routes", "controller", "handler", "endpoint", "api"],
    "Service Layer": ["service", "usecase", "use-case", "business"],
    "Data Layer": ["model", "entity", "schema", "database", "db", "migration", "repository", "repo"],
    "UI Layer": ["component", "view", "page", "screen", "layout", "widget", "ui"],
    "Middleware Layer": ["middleware", "interceptor", "guard", "filter", "pipe"],
    "External Services": ["client", "integration", "external", "sdk", "vendor", "adapter"],
    "Background Tasks": ["worker", "job", "queue", "cron", "consumer", "processor", "scheduler", "background"],
    "Utility Layer": ["util", "helper", "lib", "common", "shared"],
    "Test Layer": ["test", "spec", "__test__", "__spec__", "__tests__", "__specs__"],
    "Configuration Layer": ["config", "setting", "env"],
}
# fixed values: languages by extension
LANGUAGE_EXTENSIONS = {
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyi"],
    "go": ["go"],
    "rust": ["rs"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "scala": ["scala", "sc", "sbt"],
    "csharp": ["cs"],
    "swift": ["swift"],
    "lua": ["lua"],
    "ruby": ["rb", "rake"],
    "php": ["php"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"],
    "vue": ["vue"],
    "svelte": ["svelte"],
    "shell": ["sh", "bash", "zsh"],
    "powershell": ["ps1", "psm1", "psd1"],
    "batch": ["bat", "cmd"],
    "html": ["html", "htm"],
    "css": ["css", "scss", "sass", "less"],
    "markdown": ["md", "mdx", "rst"],
    "yaml": ["yaml", "yml"],
    "json": ["json"],
    "jsonc": ["jsonc"],
    "toml": ["toml"],
    "xml": ["xml", "xsl", "xsd", "plist"],
    "config": ["cfg", "ini", "env"],
    "sql": ["sql"],
    "graphql": ["graphql", "gql"],
    "protobuf": ["proto"],
    "prisma": ["prisma"],
    "csv": ["csv", "tsv"],
    "terraform": ["tf", "tfvars"],
}
# fixed values: languages by file name
LANGUAGE_FILES = {"dockerfile": ["Dockerfile"], "makefile": ["Makefile", "GNUmakefile", "makefile"], "jenkinsfile": ["Jenkinsfile"], "procfile": ["Procfile"], "vagrantfile": ["Vagrantfile"]}
# fixed values: file categories by extension; all others are "code"
CATEGORY_EXTENSIONS = {
    "docs": ["md", "mdx", "rst", "txt", "text"],
    "config": ["yaml", "yml", "json", "jsonc", "toml", "xml", "xsl", "xsd", "plist", "cfg", "ini", "env", "properties", "csproj", "sln", "mod", "sum", "gradle", "sbt"],
    "infra": ["tf", "tfvars"],
    "data": ["sql", "graphql", "gql", "proto", "prisma", "csv", "tsv"],
    "script": ["sh", "bash", "zsh", "ps1", "psm1", "psd1", "bat", "cmd"],
    "markup": ["html", "htm", "css", "scss", "sass", "less"],
}
# fixed values: files that are infrastructure by name
INFRA_FILES = ["Dockerfile", ".dockerignore", "Makefile", "GNUmakefile", "makefile", "Jenkinsfile", "Procfile", "Vagrantfile", ".gitlab-ci.yml", "compose.yml", "compose.yaml"]
# fixed values: patterns ignored by default
IGNORED = """
node_modules/ .git/ vendor/ venv/ .venv/ __pycache__/
dist/ build/ out/ coverage/ .next/ .cache/ .turbo/ target/ obj/
*.lock package-lock.json yarn.lock pnpm-lock.yaml
*.png *.jpg *.jpeg *.gif *.svg *.ico *.woff *.woff2 *.ttf *.eot *.mp3 *.mp4 *.pdf *.zip *.tar *.gz
*.min.js *.min.css *.map *.generated.*
.idea/ .vscode/
LICENSE .gitignore .editorconfig .prettierrc .eslintrc* *.log
""".split()

# fixed values: frameworks, the files that name them, and the words that tell them
FRAMEWORKS = {
    "django": (["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile"], ["django", "djangorestframework", "django-rest-framework", "django-cors-headers", "django-filter"]),
    "express": (["package.json"], ['"express":', "express-validator", "express-session"]),
    "fastapi": (["requirements.txt", "pyproject.toml", "setup.py"], ["fastapi", "uvicorn", "starlette"]),
    "flask": (["requirements.txt", "pyproject.toml", "setup.py"], ["flask", "flask-restful", "flask-sqlalchemy"]),
    "gin": (["go.mod"], ["github.com/gin-gonic/gin"]),
    "nextjs": (["package.json"], ['"next":', "@next/font", "@next/image"]),
    "rails": (["Gemfile"], ["rails", "railties", "actionpack"]),
    "react": (["package.json"], ["react", "react-dom", "@types/react"]),
    "spring": (["pom.xml", "build.gradle", "build.gradle.kts"], ["spring-boot", "spring-boot-starter", "spring-web"]),
    "vue": (["package.json"], ["vue", "@vue/cli-service", "nuxt", "vite-plugin-vue"]),
}
# fixed values: labels of folders by name
FOLDER_LABELS = {
    "api": ["routes", "api", "controllers", "endpoints", "handlers", "serializers", "controller", "routers", "blueprints"],
    "service": ["services", "core", "lib", "domain", "logic", "signals", "internal", "composables", "mailers", "jobs", "channels"],
    "data": ["models", "db", "data", "persistence", "repository", "entities", "migrations", "entity", "sql", "database", "schema"],
    "ui": ["components", "views", "pages", "ui", "layouts", "screens"],
    "middleware": ["middleware", "plugins", "interceptors", "guards"],
    "utility": ["utils", "helpers", "common", "shared", "tools", "templatetags", "pkg"],
    "config": ["config", "constants", "env", "settings", "management", "commands"],
    "test": ["__tests__", "test", "tests", "spec", "specs"],
    "types": ["types", "interfaces", "schemas", "contracts", "dtos", "dto", "request", "response"],
    "hooks": ["hooks"],
    "state": ["store", "state", "reducers", "actions", "slices"],
    "assets": ["assets", "static", "public"],
    "entry": ["cmd", "bin"],
    "documentation": ["docs", "documentation", "wiki"],
    "infrastructure": ["deploy", "deployment", "infra", "infrastructure", "k8s", "kubernetes", "helm", "charts", "terraform", "tf", "docker"],
    "ci-cd": [".github", ".gitlab", ".circleci"],
}
# fixed values: labels of files by patterns of their paths, in order
FILE_LABELS = [
    ("test", r"\.(test|spec)\.[^/]+$|(^|/)test_[^/]*\.py$|_test\.go$|Test\.java$|_spec\.rb$|Test\.php$|Tests\.cs$"),
    ("types", r"\.d\.ts$"),
    ("entry", r"(^|/)(index\.ts|index\.js|__init__\.py|Application\.java|Program\.cs|config\.ru)$|^manage\.py$|(^|/)cmd/[^/]+/main\.go$|(^|/)src/(main|lib)\.rs$"),
    ("config", r"(^|/)(wsgi\.py|asgi\.py|Cargo\.toml|go\.mod|Gemfile|pom\.xml|build\.gradle|composer\.json)$"),
    ("infrastructure", r"(^|/)(Dockerfile|docker-compose\.[^/]*|Makefile)$|\.(tf|tfvars)$"),
    ("ci-cd", r"^\.github/workflows/|(^|/)(\.gitlab-ci\.yml|Jenkinsfile)$"),
    ("data", r"\.sql$"),
    ("types", r"\.(graphql|gql|proto)$"),
    ("documentation", r"\.(md|rst)$"),
]
# fixed values: names of files where programs begin
ENTRY_FILES = [
    "index.ts", "index.js", "main.ts", "main.js", "app.ts", "app.js", "server.ts", "server.js", "mod.rs", "main.go", "main.py", "main.rs", "manage.py", "app.py", "wsgi.py", "asgi.py",
    "run.py", "__main__.py", "Application.java", "Main.java", "Program.cs", "config.ru", "index.php", "App.swift", "Application.kt", "main.cpp", "main.c",
]
