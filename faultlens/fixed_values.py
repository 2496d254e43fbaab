"""Word lists, prefixes and constants that results depend on."""

# fixed values: rank-fusion and search constants
RRF_K = 60
ROUTING_WEIGHT = 2.0
COMPONENT_WEIGHT = 1.0
LOG_WEIGHT = 0.15
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
TOKEN_TOP_K = 20
VECTOR_TOP_K = 50
BLOCK_LINES = 400

# fixed values: abstain thresholds (margin, score) per score scale
TAU_MEMBERSHIP = (1.0, 1.0)
TAU_SEMANTIC = (0.05, 0.0)
TAU_JUDGE = (1.0, 0.0)
TAU_RRF = (0.005, 0.01)

# fixed values: framework package prefixes and system sonames, never the fault site
FRAMEWORK_PREFIXES = (
    "android. java. javax. kotlin. kotlinx. dalvik. com.android. com.google.android. "
    "androidx.fragment. androidx.appcompat. androidx.core. androidx.recyclerview. "
    "androidx.lifecycle. androidx.activity."
).split()
FRAMEWORK_SONAMES = (
    "libc.so libart.so libaaudio.so libandroid.so libbinder.so libgui.so libutils.so libhwui.so "
    "libEGL.so libGLESv1_CM.so libGLESv2.so libGLESv3.so libbase.so libcutils.so"
).split()

# fixed values: words that are never a literal anchor
ANCHOR_STOPLIST = (
    "the a an is are when then fails fail app log logs file value null true false should not "
    "instead of in and this that shown"
).split()

# fixed values: generic sonames and identifiers kept by the scrubber
GENERIC_SONAMES = (
    "libc.so libm.so libdl.so liblog.so libandroid.so libart.so libbinder.so libEGL.so "
    "libGLESv1_CM.so libGLESv2.so libGLESv3.so libvulkan.so libOpenSLES.so libaaudio.so "
    "libmediandk.so libnativehelper.so libjnigraphics.so libz.so libc++.so libstdc++.so libffmpeg.so"
).split()
GENERIC_IDENTIFIERS = (
    "onCreate onStart onResume run init main read write open close Activity Fragment Service View "
    "Handler Runnable"
).split()
GENERIC_ORGS = "android androidx google com org io team app".split()
SHINGLE_SKIP = ["return null;", "}", "{", "});"]
MIN_SHINGLE = 24

# fixed values: call-like names that are not an API
API_STOPWORDS = (
    "if for while switch catch return new sizeof synchronized do else when try throw throws super "
    "this assert case yield public private protected static final abstract class interface enum "
    "void fun val var def lambda print println await async int long float double char bool boolean "
    "byte short str string list map set dict object array"
).split()

# fixed values: production-file rules of the miner
PROD_ROOTS = ["src/main/", "app/src/main/", "library/src/main/"]
PROD_EXTENSIONS = [".java", ".kt", ".cpp", ".cc", ".c", ".h", ".hpp", ".mm"]
PROD_EXCLUDED = ["/test/", "/androidtest/", "/src/test/", "/resources/mocks", "/testdata/",
                 "/fixtures/", "/samples/"]
PROD_STATUS = ["added", "modified", "renamed"]
CHANGE_TYPES = {
    "ADDED": "added", "MODIFIED": "modified", "REMOVED": "removed", "DELETED": "removed",
    "RENAMED": "renamed", "COPIED": "copied", "CHANGED": "changed",
}
NON_DEFECT_LABELS = ["enhancement", "question", "duplicate", "wontfix", "invalid", "feature",
                     "feature request", "documentation"]
NEGATIVE_CLASSES = ["out_of_fleet", "coverage_gap", "insufficient_signal", "not_a_defect"]
NEGATIVE_OWNERS = ["__NOT_A_DEFECT__", "__OUT_OF_FLEET__"]

# fixed values: source-root markers, in match order
SOURCE_ROOTS = ("src/main/java/ src/main/kotlin/ src/java/ src/kotlin/ java/ kotlin/ src/main/ "
                "src/").split()
MODULE_EXTENSIONS = (".py .js .ts .java .cs .cpp .hpp .h .c .tsx .jsx .cc .mjs .cxx .cc .cjs .kt "
                     ".kts").split()

# fixed values: rule predicate vocabulary, tiers and required clauses
SIGNAL_FAMILIES = ["packages", "classes", "methods", "symbols", "libraries", "errors"]
TOKEN_ORDER = ["classes", "packages", "methods", "symbols", "libraries", "errors"]
TIERS = ["candidate", "applied", "validated", "canonical"]
RULE_CLAUSES = ["Signature:", "Localize:", "Fix:"]
PLACEBO_FILLER = (
    "placebo control text of matched length that conveys no diagnostic or corrective information and "
    "points at nothing in particular so the treatment and control differ solely in the wording injected "
)

# fixed values: match-strategy confidence of the entity map
MATCH_CONFIDENCE = {"exact": 1.0, "qualified_suffix": 0.85, "file_only": 0.5}

# fixed values: extension to language
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript",
    ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".c++": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".rs": "rust", ".go": "go", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".cs": "csharp",
}

# fixed values: file-role patterns
ENTRY_FILES = (
    "main.py app.py server.py __main__.py run.py start.py manage.py wsgi.py asgi.py gunicorn.py "
    "index.js app.js server.js main.js index.ts app.ts server.ts main.ts start.js start.ts "
    "bootstrap.js bootstrap.ts entry.js entry.ts main.go cmd.go server.go app.go root.go start.go "
    "main.rs lib.rs server.rs app.rs start.rs bin.rs main.c main.cpp main.cc main.cxx app.c app.cpp "
    "start.c start.cpp entry.c entry.cpp index.php app.php bootstrap.php artisan console server.php "
    "start.php"
).split()
ENTRY_PATHS = (
    "cmd/main cmd/root cmd/server src/main src/app src/server bin/main bin/app bin/server app/main "
    "app/server app/start scripts/start scripts/run"
).split()
ENTRY_NAMES = ("main app server start run entry bootstrap init cmd cli daemon service worker "
               "launcher").split()
ENTRY_EXTENSIONS = ".py .js .ts .go .rs .c .cpp".split()
CONNECTED_NAMES = (
    "router controller service handler middleware api core engine manager processor client mod "
    "module pkg package lib util utils helper helpers express fastapi gin actix rocket db database "
    "model entity repo repository config settings constants types interfaces console text style "
    "render display format parse parser convert transform process table tree list grid layout "
    "widget color theme visual graphic draw paint file io stream buffer cache store base common "
    "shared global main index"
).split()
SOURCE_DIRS = ("src/ lib/ core/ pkg/ cmd/ internal/ crates/ modules/ include/ source/ components/ "
               "services/ utils/").split()
CRITICAL_NAMES = "main index app server start init run new".split()
EXPORT_MARKS = ["export default", "module.exports =", "exports.", "pub fn main", "pub fn new", "pub fn",
                "func main", "func new", "int main", "void main", "public static void main",
                'if __name__ == "__main__"']
FALLBACK_NAMES = "main app server start index".split()
FALLBACK_FIRST = "main app index".split()
FALLBACK_EXTENSIONS = ".py .js .go .rs".split()
FALLBACK_DIRS = "src/ lib/ app/ pkg/ core/".split()
FALLBACK_TEST_MARKS = "test spec _test".split()
README_NAMES = ["README.md", "README", "readme.md", "README.txt"]
COMPONENT_TYPES = ["class", "interface", "struct", "enum", "record", "abstract class", "annotation",
                   "delegate"]
LEAF_TYPES = ["class", "interface", "struct"]
LEAF_JUNK = ["error", "exception", "failed", "invalid"]
LEAF_LIMIT = 400

# fixed values: language-level external symbols
RUNTIME_PREFIXES = ["java.", "javax.", "jdk.", "sun.", "std::"]
C_EXTERNAL = (
    "abort abs asctime assert atof atoi atol bsearch clock ctime difftime fabs feof ferror fflush "
    "fgetc fgets fputc fputs fseek ftell getc getchar getenv gmtime isalnum isalpha iscntrl islower "
    "ispunct isupper isxdigit localtime longjmp memchr mktime putc putchar puts qsort rand remove "
    "rename rewind setjmp sprintf srand strdup strftime strncat strncmp strncpy strrchr strtod strtol "
    "strtoul system tolower toupper ungetc va_arg va_copy vfprintf vprintf vsprintf atexit calloc "
    "exit fclose fopen fprintf ftruncate fread free fwrite getline ioctl isatty isdigit isprint "
    "isspace malloc memcmp memcpy memmove memset open perror printf read realloc scanf snprintf "
    "sscanf strcat strchr strerror strcmp strcpy strlen strstr tcgetattr tcsetattr time close signal "
    "va_end va_start vsnprintf write"
).split()
CPP_EXTERNAL = (
    "at append back basic_string begin capacity cbegin cend cin clear contains count cout c_str data "
    "delete find emplace emplace_back endl empty end erase exception forward front function "
    "initializer_list insert length lower_bound make_pair make_shared make_tuple make_unique move new "
    "optional pair pop_back pop_front push_back push_front rbegin rend reserve resize shared_ptr "
    "shrink_to_fit size static_assert std string string_view substr swap tuple unique_ptr upper_bound "
    "vector what"
).split()
JAVA_EXTERNAL = (
    "Appendable AutoCloseable Boolean Byte Character CharSequence Class ClassLoader Cloneable "
    "Comparable Double Enum Float Integer Iterable Long Math Module Number Object Package Process "
    "ProcessBuilder Readable Record Runnable Runtime Short StackTraceElement StrictMath String "
    "StringBuffer StringBuilder System Thread ThreadGroup ThreadLocal Void ArithmeticException "
    "ArrayIndexOutOfBoundsException ArrayStoreException AssertionError ClassCastException "
    "ClassNotFoundException CloneNotSupportedException Error Exception IllegalAccessException "
    "IllegalArgumentException IllegalStateException IndexOutOfBoundsException InstantiationException "
    "InterruptedException LinkageError NegativeArraySizeException NoClassDefFoundError "
    "NoSuchFieldException NoSuchMethodException NullPointerException NumberFormatException "
    "OutOfMemoryError ReflectiveOperationException RuntimeException SecurityException "
    "StackOverflowError StringIndexOutOfBoundsException Throwable UnsupportedOperationException "
    "VirtualMachineError Deprecated FunctionalInterface Override SafeVarargs SuppressWarnings"
).split()
NON_MACRO_UPPER = ["FALSE", "TRUE", "NULL", "EOF", "EXIT_SUCCESS", "EXIT_FAILURE"]

# fixed values: default globs of the source-tree scan
IGNORE_GLOBS = (
    ".github .vscode .git .gitignore .gitmodules examples *.pyc *.pyo *.pyd __pycache__ .pytest_cache .coverage .tox .nox "
    ".mypy_cache .ruff_cache .hypothesis poetry.lock Pipfile.lock node_modules/ node_modules package-lock.json yarn.lock .npm "
    ".yarn .pnpm-store .next/ .nuxt/ .turbo/ bun.lock bun.lockb *.class *.jar *.war *.ear *.nar .gradle/ .settings/ .classpath "
    "gradle-app.setting *.gradle .project *.o *.obj *.dll *.dylib *.exe *.lib *.out *.a *.pdb *.suo *.user *.userosscache "
    "*.sln.docstates *.nupkg bin/ .svn .hg .gitattributes *.svg *.png *.jpg *.jpeg *.gif *.ico *.pdf *.mov *.mp4 *.mp3 *.wav "
    "venv .venv env .env virtualenv .idea .vs *.swo *.swn *.sublime-* *.log *.bak *.swp *.tmp *.temp .cache .sass-cache "
    ".DS_Store Thumbs.db desktop.ini *.egg-info *.egg *.whl *.so .docusaurus *.min.js *.min.css *.map .terraform *.tfstate* "
    "digest.txt *.ini tests test Tests Test Examples"
).split()
INCLUDE_GLOBS = (
    "*.py *.js *.ts *.jsx *.tsx *.java *.cpp *.cc *.cxx *.c++ *.c *.h *.hpp *.hxx *.h++ *.cs *.go *.rs *.php *.rb *.swift "
    "*.kt *.kts *.scala *.clj *.hs *.ml *.html *.css *.scss *.sass *.json *.yaml *.yml *.xml *.md *.txt *.toml *.cfg *.ini"
).split()

# fixed values: light symbol index and profile limits
LITE_EXTENSIONS = ".java .kt .cpp .cc .cxx .c .h .hpp .mm".split()
PROFILE_SKIP = [".git", "build", "node_modules"]
UNPINNED = "PIN_AT_CLONE"
