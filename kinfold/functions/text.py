"""Names, paths and bodies: predicates and text kernels as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hxx", ".hpp", ".H", ".HPP", ".inl")
TEST_NAMES = ("test", "tests", "test.c", "tests.c", "example", "examples", "example.c", "examples.c", "demo", "docs", "doc", "documents", "document")
COMPILER_SYMBOLS = (
    ".init_proc", "__libc_start_main", "__libc_csu_init", "_start", "main", "register_tm_clones", "deregister_tm_clones", "__stack_chk_fail", "__error_location", "_exit", "__do_global_dtors_aux",
    "__cxa_finalize", "__cxa_throw", "__cxa_rethrow", "__cxa_begin_catch", "__cxa_end_catch", "__cxa_guard_release", "__cxa_guard_abort", "__cxa_guard_acquire", "__cxa_atexit", "__cxa_free_exception", "__cxa_allocate_exception", "__cxa_demangle",
    "__sched_cpucount",
)
LIBC_SYMBOLS = (
    "malloc", "malloc_usable_size", "alloc", "calloc", "realloc", "memalign", "memset", "free", "strlen", "strlen_s", "strcmp", "strcmp_s", "posix_memalign", "gethostname", "start_routine",
    "mem_init", "sig_handler", "backtrace", "regexec", "regcomp", "regerror", "__udivti3", "__isoc99_vsscanf", "_Unwind_Backtrace",
)
NATIVE_SUPPORT = ("operator delete[](void*)", "operator delete(void*, std::nothrow_t const&)", "operator delete[](void*, std::nothrow_t const&)", "operator delete", "operator delete[]", "operator new", "operator new[]")
#: Prefixes of run-time support code, a parameter of the filters below.
ABI_PREFIXES = ("__cxa_", "__gnu_cxx::")
COMMON_SCOPES = ("std", "main")


def is_source_path(path: Column) -> Column:
    """A C or C++ source by suffix, with no path component that names tests, examples or documents."""
    suffix = F.lit(False)
    for s in SOURCE_SUFFIXES:
        suffix = suffix | path.endswith(s)
    return suffix & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_NAMES)))


def is_generated_symbol(name: Column) -> Column:
    return name.rlike("^sub_[0-9A-F]+$")


def is_compiler_symbol(name: Column) -> Column:
    return name.isin(*COMPILER_SYMBOLS)


def is_libc_symbol(name: Column) -> Column:
    return name.isin(*LIBC_SYMBOLS)


def is_native_support(name: Column) -> Column:
    return name.isin(*NATIVE_SUPPORT)


def is_skipped_symbol(name: Column) -> Column:
    return is_generated_symbol(name) | is_compiler_symbol(name) | is_libc_symbol(name)


def is_std(name: Column) -> Column:
    return name.startswith("std::")


def is_thread_or_posix(name: Column) -> Column:
    return name.startswith("pthread_") | name.startswith("posix_")


def is_destructor(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1).startswith("~")


def is_filtered_function(name: Column, abi_prefixes: tuple[str, ...] = ABI_PREFIXES) -> Column:
    """Names that never say which component a program reuses."""
    out = is_skipped_symbol(name) | is_std(name) | is_thread_or_posix(name) | is_native_support(name)
    for p in abi_prefixes:
        out = out | name.startswith(p)
    return out


def body_of(source: Column) -> Column:
    """What stands between the outer braces, or one space where there are none."""
    return F.when(source.rlike(r"(?s)\{.*\}"), F.regexp_extract(source, r"(?s)\{(.*)\}", 1)).otherwise(F.lit(" "))


def strip_comments(source: Column) -> Column:
    """Without comments and braces; literals stay as they are. Possessive groups keep long literals off the stack."""
    pattern = r"""(?s)//[^\n]*+|[{}]++|/\*.*?\*/|('(?:[^\\']++|\\.)*+'|"(?:[^\\"]++|\\.)*+"|[^/'"{}]++|.)"""
    return F.array_join(F.regexp_extract_all(source, F.lit(pattern), 1), "")


def normalise_body(body: Column) -> Column:
    """Lower case without line breaks, tabs, braces and spaces."""
    return F.lower(F.translate(body, "\n\r\t{} ", ""))


def subtokens(identifier: Column) -> Column:
    """Lower-case parts of an identifier, cut at case changes, underscores, digits and white space."""
    parts = F.split(identifier, r"(?<=[a-z])(?=[A-Z])|_|[0-9]|(?<=[A-Z])(?=[A-Z][a-z])|\s+")
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def without_suffix(symbol: Column) -> Column:
    """Drops ``.suffix`` of clones, unless the name begins with the dot."""
    return F.when(symbol.contains(".") & ~symbol.startswith("."), F.substring_index(symbol, ".", 1)).otherwise(symbol)


def scope_of(name: Column) -> Column:
    parts = F.split(name, "::")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::"))


def last_name_of(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def without_templates(name: Column) -> Column:
    """Greedy: from the first < to the last >."""
    return F.regexp_replace(name, "<.*>", "")


def prefixes(name: Column, whole: bool = False) -> Column:
    """All scopes that hold a name, outermost first; ``whole`` counts the name itself as a scope."""
    parts = F.split(name, "::")
    n = F.size(parts) if whole else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "::"))).otherwise(F.array().cast("array<string>"))


def full_name(scope: Column, name: Column) -> Column:
    return F.concat_ws("::", scope, name)


def repo_of_url(url: Column) -> Column:
    """Owner and repository of an address, as one name."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z+]+://", ""), r"(\.git)?/*$", "")
    return F.replace(path, F.lit("/"), F.lit("@@"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def repo_on_host(url: Column) -> Column:
    """The same without the host."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z+]+://", ""), r"(\.git)?/*$", "")
    return F.replace(F.regexp_replace(path, "^[^/]*/", ""), F.lit("/"), F.lit("@@"))


def repo_of_dump(path: Column) -> Column:
    """The repository that a dump file is of: its base name without the suffix and separators at its end."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"\.pkl$", ""), "(@@)+$", "")


def tag_of_index(path: Column) -> Column:
    """The tag in the name of a hash index, ``latest`` where it names none."""
    tag = F.regexp_extract(base_name(path), r"^fuzzy_(.*)\.hidx$", 1)
    return F.when(tag == "", "latest").otherwise(tag)
