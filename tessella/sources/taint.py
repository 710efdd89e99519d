"""Where untrusted values come from and where they do harm: the exact text of callees, by language."""

from __future__ import annotations

#: (language, role, tag, callees), from the languages' own documentation. Member expressions of JavaScript are looked up alike.
CATALOGUE = (
    ("python", "source", "env", ("os.getenv", "os.environ.get")),
    ("python", "source", "input", ("input", "sys.stdin.read", "sys.stdin.readline")),
    ("python", "source", "request", ("request.args.get", "request.form.get", "request.get_json", "request.cookies.get", "request.headers.get")),
    ("python", "source", "network", ("requests.get", "requests.post", "urllib.request.urlopen")),
    ("python", "sink", "command", ("os.system", "os.popen", "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output")),
    ("python", "sink", "code", ("eval", "exec", "compile", "pickle.loads", "yaml.load")),
    ("python", "sink", "sql", ("cursor.execute", "cursor.executemany", "connection.execute", "session.execute")),
    ("python", "sink", "file", ("open", "shutil.rmtree", "os.remove")),
    ("javascript", "source", "env", ("process.env",)),
    ("javascript", "source", "request", ("req.body", "req.query", "req.params", "req.headers", "req.cookies")),
    ("javascript", "source", "page", ("document.cookie", "location.search", "location.hash", "window.location.href", "localStorage.getItem")),
    ("javascript", "source", "network", ("fetch", "axios.get", "axios.post")),
    ("javascript", "sink", "command", ("child_process.exec", "child_process.execSync", "child_process.spawn", "execSync")),
    ("javascript", "sink", "code", ("eval", "Function", "vm.runInNewContext", "setTimeout")),
    ("javascript", "sink", "page", ("document.write", "document.writeln", "element.insertAdjacentHTML")),
    ("javascript", "sink", "sql", ("db.query", "connection.query", "pool.query", "sequelize.query")),
    ("rust", "source", "env", ("std::env::var", "env::var", "std::env::args", "env::args")),
    ("rust", "source", "input", ("std::io::stdin", "io::stdin")),
    ("rust", "source", "network", ("reqwest::get", "reqwest::blocking::get")),
    ("rust", "sink", "command", ("Command::new", "std::process::Command::new")),
    ("rust", "sink", "file", ("std::fs::write", "fs::write", "std::fs::remove_file", "fs::remove_file", "File::create")),
    ("rust", "sink", "sql", ("sqlx::query", "diesel::sql_query")),
)
#: Languages that share another's entries.
SAME_AS = {"typescript": "javascript", "tsx": "javascript", "vue": "javascript", "svelte": "javascript"}
ROWS = [(lang, callee, role, tag) for lang, role, tag, callees in CATALOGUE for callee in callees]
ROWS += [(other, callee, role, tag) for other, lang in SAME_AS.items() for own, callee, role, tag in ROWS if own == lang]
