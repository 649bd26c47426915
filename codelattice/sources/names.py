"""Names that extractors pass over: standard libraries, and built-in names that never become nodes."""

from __future__ import annotations

import sys

# Modules and packages of standard libraries, and built-in names per language.
NODE_MODULES = frozenset(
    """assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector
    module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi
    worker_threads zlib""".split()
)
PYTHON_MODULES = frozenset(sys.stdlib_module_names) | frozenset(
    """aifc asynchat asyncore binhex cgi cgitb chunk crypt distutils imghdr imp lib2to3 mailcap nis nntplib ossaudiodev pipes smtpd sndhdr sunau telnetlib
    test uu xdrlib _thread __future__ __main__""".split()
)
GO_PACKAGES = frozenset(
    """archive bufio builtin bytes cmp compress container context crypto database debug embed encoding errors expvar flag fmt go hash html image index
    internal io iter log maps math mime net os path plugin reflect regexp runtime slices sort strconv strings structs sync syscall testing text time
    unicode unique unsafe""".split()
)
JAVA_PACKAGES = frozenset("java javax jdk sun System Runtime Process ProcessBuilder Scanner".split())
JAVA_PREFIXES = ("java.", "javax.", "jdk.", "sun.", "com.sun.", "org.xml.", "org.w3c.")
RUST_CRATES = frozenset(
    """std core alloc proc_macro test collections env fmt fs io iter mem net num ops os path process ptr rc result slice str string sync thread time vec any
    borrow boxed cell clone cmp convert default error ffi future hash marker option panic pin prelude task""".split()
)
CPP_HEADERS = frozenset(
    """algorithm any array atomic barrier bit bitset cassert cctype cerrno cfenv cfloat charconv chrono cinttypes climits clocale cmath codecvt compare complex
    concepts condition_variable coroutine csetjmp csignal cstdarg cstddef cstdint cstdio cstdlib cstring ctime cuchar cwchar cwctype deque exception
    execution expected filesystem format forward_list fstream functional future generator initializer_list iomanip ios iosfwd iostream istream iterator
    latch limits list locale map mdspan memory memory_resource mutex new numbers numeric optional ostream print queue random ranges ratio regex
    scoped_allocator semaphore set shared_mutex source_location span spanstream sstream stack stacktrace stdexcept stdfloat stop_token streambuf string
    string_view strstream syncstream system_error thread tuple type_traits typeindex typeinfo unordered_map unordered_set utility valarray variant vector
    version assert.h complex.h ctype.h errno.h fenv.h float.h inttypes.h iso646.h limits.h locale.h math.h setjmp.h signal.h stdalign.h stdarg.h
    stdatomic.h stdbool.h stddef.h stdint.h stdio.h stdlib.h stdnoreturn.h string.h tgmath.h threads.h time.h uchar.h wchar.h wctype.h unistd.h fcntl.h
    sys/types.h sys/stat.h sys/socket.h netinet/in.h arpa/inet.h pthread.h dirent.h dlfcn.h""".split()
)
_SCRIPT_GLOBALS = frozenset(
    """Object Array String Number Boolean Symbol BigInt Promise Date RegExp Map Set WeakMap WeakSet WeakRef Error AggregateError EvalError RangeError
    ReferenceError SyntaxError TypeError URIError ArrayBuffer SharedArrayBuffer DataView Function Intl JSON Math Reflect Proxy Atomics globalThis NaN
    Infinity undefined parseInt parseFloat isNaN isFinite decodeURI decodeURIComponent encodeURI encodeURIComponent escape unescape eval Int8Array
    Uint8Array Uint8ClampedArray Int16Array Uint16Array Int32Array Uint32Array Float32Array Float64Array BigInt64Array BigUint64Array WebAssembly
    FinalizationRegistry process global Buffer URL URLSearchParams TextEncoder TextDecoder AbortController AbortSignal EventTarget Event MessageChannel
    MessagePort MessageEvent queueMicrotask structuredClone atob btoa performance console crypto setImmediate clearImmediate require""".split()
)
_SCRIPT_MEMBERS = frozenset(
    """length name prototype assign create defineProperty defineProperties entries freeze fromEntries getOwnPropertyNames getPrototypeOf hasOwn is isFrozen
    isSealed keys seal setPrototypeOf values hasOwnProperty isPrototypeOf propertyIsEnumerable toLocaleString toString valueOf constructor from isArray of
    at concat copyWithin every fill filter find findIndex findLast findLastIndex flat flatMap forEach includes indexOf join lastIndexOf map pop push
    reduce reduceRight reverse shift slice some sort splice unshift with toReversed toSorted toSpliced fromCharCode fromCodePoint raw charAt charCodeAt
    codePointAt endsWith localeCompare match matchAll normalize padEnd padStart repeat replace replaceAll search split startsWith substr substring
    toLowerCase toUpperCase trim trimEnd trimStart isInteger isSafeInteger toExponential toFixed toPrecision for keyFor description all allSettled any
    race reject resolve then catch finally now parse UTC getDate getDay getFullYear getHours getMilliseconds getMinutes getMonth getSeconds getTime
    getTimezoneOffset setDate setFullYear setHours setMinutes setMonth setSeconds setTime toISOString toJSON exec test compile flags source clear
    delete get has set size add captureStackTrace message stack cause isView byteLength resize apply bind call""".split()
)
_BROWSER = frozenset(
    """window document navigator location history screen localStorage sessionStorage fetch Headers Request Response setTimeout clearTimeout setInterval
    clearInterval requestAnimationFrame cancelAnimationFrame alert confirm prompt Event CustomEvent Node Element HTMLElement CSSProperties HTMLDivElement
    HTMLSpanElement HTMLInputElement HTMLButtonElement HTMLCanvasElement HTMLVideoElement HTMLAudioElement HTMLImageElement HTMLAnchorElement
    HTMLFormElement SVGElement Blob File FileList FileReader FormData Audio AudioContext webkitAudioContext BroadcastChannel IntersectionObserver
    ResizeObserver MutationObserver Timeout CanvasTextBaseline closest blur focus click select querySelector querySelectorAll getElementById
    getElementsByClassName getElementsByTagName createElement appendChild removeChild replaceChild insertBefore cloneNode contains getAttribute
    setAttribute removeAttribute classList addEventListener removeEventListener dispatchEvent preventDefault stopPropagation getBoundingClientRect
    postMessage Partial Required Readonly Record Pick Omit Exclude Extract NonNullable Parameters ConstructorParameters ReturnType InstanceType
    ThisParameterType OmitThisParameter ThisType Awaited NodeJS""".split()
)
BUILT_INS = {
    "ts": _SCRIPT_GLOBALS | _SCRIPT_MEMBERS | _BROWSER,
    "py": frozenset(
        """print len range dict list set tuple open sum max min abs str int float enumerate zip any all map filter sorted repr isinstance type self cls
        __init__ bool bytes chr ord dir id hash input pow round globals locals vars super property staticmethod classmethod next iter getattr setattr
        hasattr delattr callable eval exec format slice reversed complex frozenset memoryview bytearray object breakpoint compile help ascii bin hex oct
        issubclass __str__ __repr__ __len__ __getitem__ __setitem__ __delitem__ __iter__ __next__ __call__ __enter__ __exit__ __new__ __del__ __getattr__
        __getattribute__ __setattr__ __delattr__ __dir__ __eq__ __ne__ __lt__ __le__ __gt__ __ge__ __add__ __sub__ __mul__ __truediv__ __floordiv__
        __mod__ __pow__ __contains__ __hash__ __bool__ __format__ __init_subclass__ __class_getitem__ append extend insert remove pop clear index count
        sort reverse copy update get keys values items setdefault join split strip lstrip rstrip startswith endswith replace find rfind upper lower title
        capitalize encode decode format_map center ljust rjust zfill expandtabs isdigit isalpha isalnum isspace isupper islower istitle read write close
        flush seek tell readline readlines writelines Exception ValueError TypeError KeyError IndexError AttributeError ImportError RuntimeError
        SystemExit StopIteration KeyboardInterrupt AssertionError FileNotFoundError IOError OSError PermissionError NotImplementedError ZeroDivisionError
        OverflowError RecursionError List Dict Tuple Set Optional Union Any Callable Sequence Mapping Iterator Generator Coroutine Awaitable
        AsyncIterator AsyncGenerator ClassVar Final Literal TypeVar Generic Protocol TypedDict NamedTuple""".split()
    ),
    "go": frozenset(
        """true false iota nil append cap close complex copy delete imag len make new panic print println real recover complex64 complex128 uint8 uint16
        uint32 uint64 int8 int16 int32 int64 float32 float64 byte rune uint int uintptr string bool error any comparable min max clear Error String Len
        Less Swap Close Read Write Seek Flush Lock Unlock RLock RUnlock Wait Signal Broadcast Done Err Add Load Store CompareAndSwap Value Reset Stop
        Marshal Unmarshal Encode Decode ServeHTTP Header Body""".split()
    ),
    "java": frozenset(
        """void int double float boolean long char byte short null true false this super Object Class String CharSequence StringBuilder StringBuffer System
        Runtime Process Thread ThreadGroup Runnable ThreadLocal Math StrictMath Number Byte Short Integer Long Float Double Boolean Character Void
        Throwable Error Exception RuntimeException IllegalArgumentException NullPointerException IndexOutOfBoundsException UnsupportedOperationException
        IllegalStateException ClassCastException ArithmeticException ArrayIndexOutOfBoundsException StackOverflowError OutOfMemoryError
        ClassNotFoundException NoSuchMethodException SecurityException ConcurrentModificationException Iterable Cloneable Comparable AutoCloseable
        Serializable Enum Annotation Override Deprecated SuppressWarnings FunctionalInterface List ArrayList LinkedList Map HashMap TreeMap LinkedHashMap
        Set HashSet TreeSet LinkedHashSet Queue Deque ArrayDeque PriorityQueue Iterator ListIterator Collections Arrays Optional UUID Objects Date
        Calendar Locale Scanner Formatter Properties ConcurrentHashMap CopyOnWriteArrayList Vector Stack Hashtable Stream Collectors Predicate Function
        Consumer Supplier BiFunction BiConsumer print println printf format equals hashCode toString clone finalize wait notify notifyAll getClass
        compareTo iterator size isEmpty contains containsKey containsValue get put remove clear add addAll removeAll retainAll toArray stream of values
        keySet entrySet length charAt substring indexOf lastIndexOf trim split replace replaceAll startsWith endsWith toLowerCase toUpperCase matches
        join append insert delete reverse parseInt parseDouble parseLong parseFloat valueOf abs min max round ceil floor sqrt pow random close read
        write flush available run start interrupt sleep yield currentTimeMillis nanoTime gc exit getProperty setProperty getName setName getId getType
        getValue setValue""".split()
    ),
    "rs": frozenset(
        """Option Result Some None Ok Err Vec String Box Rc Arc Cell RefCell Cow BTreeMap BTreeSet HashMap HashSet Default Clone Copy Send Sync Fn FnMut
        FnOnce Drop AsRef AsMut Into From ToString Iterator IntoIterator DoubleEndedIterator ExactSizeIterator Display Debug Eq PartialEq Ord PartialOrd
        Hash Sized Unpin Add Sub Mul Div Rem Neg Not BitAnd BitOr BitXor Shl Shr Index IndexMut Deref DerefMut to_string clone as_str len is_empty push
        insert remove unwrap expect map and_then unwrap_or unwrap_or_else iter iter_mut into_iter collect contains get set as_ref as_mut into from
        try_from try_into ok err is_ok is_err is_some is_none to_owned to_vec as_slice as_bytes chars bytes lines split trim starts_with ends_with
        replace find rfind push_str pop clear extend drain retain sort sort_by reverse filter filter_map flat_map fold for_each any all count enumerate
        zip take skip chain peekable fuse read write flush seek read_to_string write_all lock try_lock join spawn with_capacity capacity reserve
        shrink_to_fit entry or_insert or_insert_with and_modify key keys values min max clamp abs pow sqrt parse format display u8 u16 u32 u64 u128
        usize i8 i16 i32 i64 i128 isize f32 f64 bool char str println print panic vec writeln dbg todo unimplemented assert assert_eq assert_ne cfg env
        option_env file line column module_path stringify concat include include_str include_bytes eprintln eprint self Self super crate std core alloc
        new""".split()
    ),
    "cpp": frozenset(
        """int float double char bool void size_t nullptr true false this auto const static extern volatile mutable register inline virtual vector string
        map set list unordered_map unordered_set shared_ptr unique_ptr make_shared make_unique weak_ptr array deque stack queue priority_queue pair tuple
        optional variant any span string_view bitset forward_list multimap multiset cout cin cerr clog endl printf scanf std main getline ignore peek
        putback get put size length empty push_back pop_back push_front pop_front begin end cbegin cend rbegin rend front back at data find count
        contains erase insert emplace emplace_back sort min max abs swap move forward to_string stoi stod stof stol stoll stoul stoull reserve resize
        capacity shrink_to_fit clear assign substr c_str append compare replace rfind find_first_of find_last_of open close read write flush good eof
        fail bad lock unlock try_lock join detach reset release use_count expired sizeof alignof decltype typeid static_cast dynamic_cast const_cast
        reinterpret_cast static_assert throw new delete""".split()
    ),
}


def is_standard(module: str, lang: str, angled: bool = False) -> bool:
    """Whether an import names a standard library, which is no node. ``angled``: a C++ include in angle brackets."""
    if lang == "ts":
        bare = module.removeprefix("node:")
        return module[:1] not in "./" and (bare in NODE_MODULES or bare.split("/")[0] in NODE_MODULES)
    if lang == "py":
        return module.split(".")[0] in PYTHON_MODULES
    if lang == "go":
        return module.split("/")[0] in GO_PACKAGES  # other names without a dot are standard if no file of the project answers them
    if lang == "java":
        return module.split(".")[0] in JAVA_PACKAGES or module.startswith(JAVA_PREFIXES)
    if lang == "rs":
        return module.split("::")[0] in RUST_CRATES
    return angled or module in CPP_HEADERS
