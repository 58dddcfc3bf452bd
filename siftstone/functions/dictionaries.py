"""Label, language and rule dictionaries, and the word lists of the audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Weakness classes in label order; label 0 is Safe, the last is Other.
TOP_CWES = ("CWE-79", "CWE-89", "CWE-78", "CWE-22", "CWE-434", "CWE-352")
LABEL_NAMES = ("Safe", *TOP_CWES, "Other")

# Language names in id order.
LANGUAGE_NAMES = (
    "Batchfile C TeX Shell Perl Lua Go Markdown C++ Python R PHP Swift Java SQL Matlab Ruby JavaScript HTML CSS "
    "CoffeeScript C# Scala PowerShell Rust Haskell TypeScript Erlang Objective-C"
).split() + ["Jupyter Notebook"]

# Language aliases of the metrics, and file extensions by language.
METRIC_LANGUAGES = {
    "python": "python", "py": "python", "c": "c", "cpp": "cpp", "c++": "cpp", "h": "cpp", "hpp": "cpp", "java": "java",
    "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "php": "php", "ruby": "ruby",
    "go": "go", "c#": "csharp", "cs": "csharp", "scala": "scala", "swift": "swift", "lua": "lua",
}
EXTENSIONS = {
    "python": ".py", "py": ".py", "javascript": ".js", "js": ".js", "typescript": ".ts", "c": ".c", "cpp": ".cpp", "java": ".java", "php": ".php",
}

_WORDISH = r"[\p{L}\p{N}_]"
# Fixed values: (language, pattern, message, severity). The word boundary is spelt out, see text.py.
STATIC_RULES = (
    ("javascript", rf"(^|[^\p{{L}}\p{{N}}_])var([^\p{{L}}\p{{N}}_]|$)", 'Uso de "var" detectado. Prefiera "let" o "const".', "LOW"),
    ("javascript", r"eval\(", 'Uso peligroso de "eval()". Riesgo de inyección.', "HIGH"),
    ("javascript", r"document\.write", "Uso de document.write. Riesgo de XSS.", "MEDIUM"),
    ("python", r"shell=True", "Uso de shell=True en subprocess.", "HIGH"),
    ("python", r"exec\(", "Uso de exec(). Riesgo de ejecución arbitraria.", "HIGH"),
    ("python", r"pickle\.load", "Deserialización insegura (pickle).", "HIGH"),
    ("python", r"md5\(", "Uso de algoritmo de hash débil (MD5).", "MEDIUM"),
    ("c", r"strcpy\(", "Uso inseguro de strcpy (Buffer Overflow). Use strncpy.", "HIGH"),
    ("c", r"gets\(", "Uso prohibido de gets (Buffer Overflow).", "CRITICAL"),
    ("c", r"sprintf\(", "Uso riesgoso de sprintf. Use snprintf.", "MEDIUM"),
    ("php", r"shell_exec\(", "Ejecución de comandos de sistema detectada.", "HIGH"),
    ("php", r"unserialize\(", "Deserialización insegura de objetos.", "HIGH"),
)

# All 257 indicator words by family; some are in several. More come in through ``indicators`` below.
INDICATORS: dict[str, tuple[str, ...]] = {
    name: tuple(words.split())
    for name, words in {
        "sql": "execute executemany executescript executequery executeupdate cursor query rawquery raw nativequery createquery preparestatement "
        "preparedstatement statement select insert update delete drop truncate alter where from join union having order group "
        "sqlalchemy hibernate jdbc mybatis sequelize knex",
        "xss": "innerhtml outerhtml innertext textcontent documentwrite writeln createelement appendchild insertadjacenthtml setattribute jquery html "
        "append prepend dangerouslysetinnerhtml bypasssecuritytrust safe mark_safe autoescape noescape",
        "command": "system popen subprocess call check_output check_call spawn fork exec execfile execl execv execve shell_exec passthru proc_open "
        "runtime getruntime processbuilder child_process execsync shell cmd command bash powershell",
        "path": "open read write readfile writefile fopen fread fwrite file_get_contents file_put_contents path join abspath realpath normpath dirname "
        "basename filepath filename include require include_once require_once sendfile download attachment listdir scandir glob walk unlink remove "
        "delete mkdir rmdir",
        "upload": "upload fileupload multipart formdata saveas move_uploaded_file moveuploaded getoriginalfilename getfilename getcontenttype mimetype "
        "extension getsize tempfile temporary",
        "csrf": "csrf csrftoken csrf_token xsrf xsrftoken antiforgery validateantiforgerytoken csrf_exempt samesite origin referer",
        "code": "eval exec compile execfile function settimeout setinterval constructor prototype reflection invoke getmethod forname template render "
        "render_template",
        "deserialisation": "pickle unpickle loads load dumps dump yaml unsafe_load marshal shelve unserialize serialize objectinputstream readobject "
        "xmldecoder deserialize jsonpickle dill",
        "input": "request req input stdin params query body form args getparameter getheader get post put delete argv environ getenv userinput userdata",
        "memory": "strcpy strcat sprintf gets scanf memcpy memmove malloc free buffer overflow",
        "entity": "xml parse parsestring etree minidom saxparser xmlreader documentbuilder loadxml entity dtd doctype",
        "server_request": "request requests urllib urlopen httplib fetch axios http https curl curl_exec httpclient webclient resttemplate",
        "secret": "password passwd secret secretkey apikey api_key token accesstoken privatekey credential auth authenticate login session cookie jwt "
        "bearer oauth hash md5 sha1 sha256 bcrypt",
        "cipher": "random rand mt_rand des rc4 md5 sha1 ecb encrypt decrypt cipher",
    }.items()
}

# Reserved words that augmentation keeps.
RESERVED_WORDS = tuple(
    (
        "def class return if else elif for while try except finally with as import from in is not and or true false none self cls lambda yield async "
        "await pass break continue raise assert global function const let var this new typeof instanceof null undefined export default require "
        "module public private protected static final void int string boolean float double char byte long short extends implements interface "
        "abstract throws throw catch super select where insert update delete join into values set order by group having limit offset create table "
        "index echo print array foreach endif endfor nil"
    ).split()
)


def indicators(extra: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """All indicator words, lower case and sorted; ``extra`` adds words and never takes any away."""
    families = [*INDICATORS.values(), *(extra or {}).values()]
    return sorted({w.lower() for words in families for w in words})


def read_families(path: str) -> dict[str, tuple[str, ...]]:
    """Families of a text file with lines ``family: word word ...``; lines without a colon are skipped."""
    with open(path, encoding="utf-8") as f:
        parts = [line.partition(":") for line in f]
    return {name.strip(): tuple(words.split()) for name, colon, words in parts if colon}
