"""Scripts judged by what their text does: families of indicators, decoded commands, addresses."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The families and their patterns, which scores depend on.
FAMILIES = {
    "downloader": r"DownloadString|DownloadFile|DownloadData|Invoke-WebRequest|\biwr\b|\bwget\b|curl\s+-|Start-BitsTransfer|bitsadmin\s+/transfer|certutil\s+.*-urlcache|XMLHTTP|WinHttp|URLDownloadToFile|Net\.WebClient|Invoke-RestMethod|\birm\b",
    "execution": r"Invoke-Expression|\bIEX\b|Start-Process|WScript\.Shell|Shell\.Application|ShellExecute|\.Run\s*\(|\.Exec\s*\(|cmd(?:\.exe)?\s*/[ck]|mshta|rundll32|regsvr32|wmic\s+process|powershell(?:\.exe)?|pwsh|cscript|wscript|msiexec\s+/[iq]|schtasks\s+/create",
    "obfuscation": r"FromBase64String|-e(?:nc(?:odedcommand)?)?\s+[A-Za-z0-9+/=]{40,}|\beval\s*\(|unescape\s*\(|String\.fromCharCode|\[char\]\s*\d+|-join\s*\(|\bchr\s*\(\s*\d+\s*\)\s*&|#@~\^|StrReverse|\^.\^.\^|-bxor|\[Convert\]::",
    "persistence": r"CurrentVersion\\Run|schtasks|New-ScheduledTask|Startup\\|New-Service|sc\s+create|Register-ScheduledJob|HKCU:|HKLM:",
    "defense evasion": r"Set-MpPreference|Add-MpPreference|-ExclusionPath|DisableRealtimeMonitoring|AmsiUtils|amsiInitFailed|-ExecutionPolicy\s+Bypass|-ep\s+bypass|-w(?:indowstyle)?\s+hidden|-nop\b|-NonInteractive|bcdedit|wevtutil\s+cl",
    "ransomware": r"vssadmin\s+delete\s+shadows|wbadmin\s+delete|shadowcopy\s+delete|cipher\s+/w",
    "system recon": r"whoami|systeminfo|ipconfig|net\s+(?:user|group|view)|nltest|Get-WmiObject|Win32_",
}
_ENCODED = re.compile(r"-e(?:nc(?:odedcommand)?)?\s+([A-Za-z0-9+/=]{20,})", re.I)


def indicators(text: Column) -> Column:
    """MAP<family, distinct hits>, at most ten of each; families without a hit are left out."""
    hits = lambda p: F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)(?:{p})"), F.lit(0)), lambda x: F.substring(F.trim(x), 1, 60)))), 1, 10)
    every = F.array(*[F.struct(F.lit(k).alias("k"), hits(p).alias("v")) for k, p in FAMILIES.items()])
    return F.map_from_entries(F.filter(every, lambda e: F.size(e["v"]) > 0))


def decode_command(word: str) -> str | None:
    """A command given in base64, of UTF-16 or UTF-8; null where it isn't mostly printable."""
    try:
        data = base64.b64decode(word + "=" * (-len(word) % 4))
    except ValueError:
        return None
    for codec in ("utf-16-le", "utf-8"):
        text = data.decode(codec, "replace")
        if text and sum(c.isprintable() or c in "\r\n\t" for c in text) > 0.9 * len(text) and "�" not in text:
            return text
    return None


def decoded_commands(text: str | None, depth: int = 0) -> list[str]:
    out = []
    for m in _ENCODED.finditer(text or ""):
        if d := decode_command(m[1]):
            out.append(d[:2000])
            if depth < 2:
                out += decoded_commands(d, depth + 1)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def commands(text: pd.Series) -> pd.Series:
    """The encoded commands in a script, decoded, down to two levels."""
    return text.map(decoded_commands)
