"""How values are shown: columns in, columns out, with a registry by field."""

from __future__ import annotations

import errno
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.predicates import FACILITIES

#: Priorities by number.
PRIORITY_LABELS = "panic alert critical error warning notice info debug".split()

#: Facilities by number, those without a common name too.
FACILITY_LABELS = dict(enumerate(FACILITIES)) | {12: "ntp", 13: "security", 14: "console", 15: "solaris-cron"} | {16 + k: f"local{k}" for k in range(8)}

#: Capabilities of Linux by number of the bit.
CAPABILITIES = (
    "CHOWN DAC_OVERRIDE DAC_READ_SEARCH FOWNER FSETID KILL SETGID SETUID SETPCAP LINUX_IMMUTABLE "
    "NET_BIND_SERVICE NET_BROADCAST NET_ADMIN NET_RAW IPC_LOCK IPC_OWNER SYS_MODULE SYS_RAWIO SYS_CHROOT SYS_PTRACE "
    "SYS_PACCT SYS_ADMIN SYS_BOOT SYS_NICE SYS_RESOURCE SYS_TIME SYS_TTY_CONFIG MKNOD LEASE AUDIT_WRITE "
    "AUDIT_CONTROL SETFCAP MAC_OVERRIDE MAC_ADMIN SYSLOG WAKE_ALARM BLOCK_SUSPEND AUDIT_READ PERFMON BPF CHECKPOINT_RESTORE"
).split()

#: Names of public message ids. Those of one vendor's own messages are given as a table (see ``with_message_names``).
MESSAGE_NAMES = dict(
    line.split(" ", 1)
    for line in """\
f77379a8490b408bbe5f6940505a777b Journal started
d93fb3c9c24d451a97cea615ce59c00b Journal stopped
a596d6fe7bfa4994828e72309e95d61e Journal messages suppressed
e9bf28e6e834481bb6f48f548ad13606 Journal messages missed
ec387f577b844b8fa948f33cad9a75e6 Journal disk space usage
fc2e22bc6ee647b6b90729ab34a250b1 Coredump
5aadd8e954dc4b1a8c954d63fd9e1137 Coredump truncated
1f4e0a44a88649939aaea34fc6da8c95 Backtrace
8d45620c1a4348dbb17410da57c60c66 User Session created
3354939424b4456d9802ca8333ed424a User Session terminated
fcbefc5da23d428093f97c82a9290f7b Seat started
e7852bfe46784ed0accde04bc864c2d5 Seat removed
24d8d4452573402496068381a6312df2 VM or container started
58432bd3bace477cb514b56381b8a758 VM or container stopped
c7a787079b354eaaa9e77b371893cd27 Time change
45f82f4aef7a4bbf942ce861d1f20990 Timezone change
50876a9db00f4c40bde1a2ad381c3a1b System configuration issues
b07a249cd024414a82dd00cd181378ff System start-up completed
eed00a68ffd84e31882105fd973abdd1 User start-up completed
6bbd95ee977941e497c48be27c254128 Sleep start
8811e6df2a8e40f58a94cea26f8ebf14 Sleep stop
98268866d1d54a499c4e98921d93bc40 System shutdown initiated
c14aaf76ec284a5fa1f105f88dfb061c System factory reset initiated
d9ec5e95e4b646aaaea2fd05214edbda Container init crashed
3ed0163e868a4417ab8b9e210407a96c System reboot failed after crash
645c735537634ae0a32b15a7c6cba7d4 Init execution froze
5addb3a06a734d3396b794bf98fb2d01 Init crashed no coredump
5c9e98de4ab94c6a9d04d0ad793bd903 Init crashed no fork
5e6f1f5e4db64a0eaee3368249d20b94 Init crashed unknown signal
83f84b35ee264f74a3896a9717af34cb Init crashed systemd signal
3a73a98baf5b4b199929e3226c0be783 Init crashed process signal
2ed18d4f78ca47f0a9bc25271c26adb4 Init crashed waitpid failed
56b1cd96f24246c5b607666fda952356 Init crashed coredump failed
4ac7566d4d7548f4981f629a28f0f829 Init crashed coredump
38e8b1e039ad469291b18b44c553a5b7 Crash shell failed to fork
872729b47dbe473eb768ccecd477beda Crash shell failed to execute
658a67adc1c940b3b3316e7e8628834a Selinux failed
e6f456bd92004d9580160b2207555186 Battery low warning
267437d33fdd41099ad76221cc24a335 Battery low powering off
79e05b67bc4545d1922fe47107ee60c5 Manager mainloop failed
dbb136b10ef4457ba47a795d62f108c9 Manager no xdgdir path
ed158c2df8884fa584eead2d902c1032 Init failed to drop capability bounding set of usermode
42695b500df048298bee37159caa9f2e Init failed to drop capability bounding set
bfc2430724ab44499735b4f94cca9295 User manager can't disable new privileges
59288af523be43a28d494e41e26e4510 Manager failed to start default target
689b4fcc97b4486ea5da92db69c9e314 Manager failed to isolate default target
5ed836f1766f4a8a9fc5da45aae23b29 Manager failed to collect passed file descriptors
6a40fbfbd2ba4b8db02fb40c9cd090d7 Init failed to fix up environment variables
0e54470984ac419689743d957a119e2e Manager failed to allocate
d67fa9f847aa4b048a2ae33535331adb Manager failed to write Smack
af55a6f75b544431b72649f36ff6d62c System shutdown critical error
d18e0339efb24a068d9c1060221048c2 Init failed to fork off valgrind
7d4958e842da4a758f6c1cdc7b36dcc5 Unit starting
39f53479d3a045ac8e11786248231fbf Unit started
be02cf6855d2428ba40df7e9d022f03d Unit failed
de5b426a63be47a7b6ac3eaac82e2f6f Unit stopping
9d1aaa27d60140bd96365438aad20286 Unit stopped
d34d037fff1847e6ae669a370e694725 Unit reloading
7b05ebc668384222baa8881179cfda54 Unit reloaded
5eb03494b6584870a536b337290809b3 Unit restart scheduled
ae8f7b866b0347b9af31fe1c80b127c0 Unit resources
7ad2d189f7e94e70a38c781354912448 Unit success
0e4284a0caca4bfc81c0bb6786972673 Unit skipped
d9b373ed55a64feb8242e02dbe79a49c Unit failure result
641257651c1b4ec9a8624d7a40a9e1e7 Process execution failed
98e322203f7a4ed290d09fe03c09fe15 Unit process exited
0027229ca0644181a76c4e92458afa2e Syslog forward missed
1dee0369c7fc4736b7099b38ecb46ee7 Mount point is not empty
d989611b15e44c9dbf31e3c81256e4ed Unit oomd kill
fe6faa94e7774663a0da52717891d8ef Unit out of memory
b72ea4a2881545a0b50e200e55b9b06f Lid opened
b72ea4a2881545a0b50e200e55b9b070 Lid closed
f5f416b862074b28927a48c3ba7d51ff System docked
51e171bd585248568110144c517cca53 System undocked
b72ea4a2881545a0b50e200e55b9b071 Power key
3e0117101eb243c1b9a50db3494ab10b Power key long press
9fa9d2c012134ec385451ffe316f97d0 Reboot key
f1c59a58c9d943668965c337caec5975 Reboot key long press
b72ea4a2881545a0b50e200e55b9b072 Suspend key
bfdaf6d312ab4007bc1fe40a15df78e8 Suspend key long press
b72ea4a2881545a0b50e200e55b9b073 Hibernate key
167836df6f7f428e98147227b2dc8945 Hibernate key long press
c772d24e9a884cbeb9ea12625c306c01 Invalid configuration
1675d7f172174098b1108bf8c7dc8f5d DNSSEC validation failed
4d4408cfd0d144859184d1e65d7c8a65 DNSSEC trust anchor revoked
36db2dfa5a9045e1bd4af5f93e1cf057 DNSSEC turned off
b61fdac612e94b9182285b998843061f Username unsafe
1b3bb94037f04bbf81028e135a12d293 Mount point path not suitable
010190138f494e29a0ef6669749531aa Device path not suitable
b480325f9c394a7b802c231e51a2752c Nobody user unsuitable
1c0454c1bd2241e0ac6fefb4bc631433 Systemd udev settle deprecated
7c8a41f37b764941a0e1780b1be2f037 Time initial sync
7db73c8af0d94eeb822ae04323fe6ab6 Time initial bump
9e7066279dc8403da79ce4b1a69064b2 Shutdown scheduled
249f6fb9e6e2428c96f3f0875681ffa3 Shutdown canceled
3f7d5ef3e54f4302b4f0b143bb270cab TPM PCR Extended
f9b0be465ad540d0850ad32172d57c21 Memory Trimmed
a8fa8dacdb1d443e9503b8be367a6adb SysV Service Found
187c62eb1e7f463bb530394f52cb090f Portable Service attached
76c5c754d628490d8ecba4c9d042112b Portable Service detached
9cf56b8baf9546cf9478783a8de42113 systemd-networkd sysctl changed by foreign process
ad7089f928ac4f7ea00c07457d47ba8a SRK into TPM authorization failure
b2bcbaf5edf948e093ce50bbea0e81ec Secure Attention Key (SAK) was pressed
7fc63312330b479bb32e598d47cef1a8 dbus activate no unit
ee9799dab1e24d81b7bee7759a543e1b dbus activate masked unit
a0fa58cafd6f4f0c8d003d16ccf9e797 dbus broker exited
c8c6cde1c488439aba371a664353d9d8 dbus dirwatch
8af3357071af4153af414daae07d38e7 dbus dispatch stats
199d4300277f495f84ba4028c984214c dbus no sopeergroup
b209c0d9d1764ab38d13b8e00d1784d6 dbus protocol violation
6fa70fa776044fa28be7a21daf42a108 dbus receive failed
0ce0fa61d1a9433dabd67417f6b8e535 dbus service failed open
24dc708d9e6a4226a3efe2033bb744de dbus service invalid
f15d2347662d483ea9bcd8aa1a691d28 dbus sighup
0ce153587afa4095832d233c17a88001 Gnome SM startup succeeded
10dd2dc188b54a5e98970f56499d1f73 Gnome SM unrecoverable failure
f3ea493c22934e26811cd62abe8e203a Gnome shell started
c7b39b1e006b464599465e105b361485 Flatpak cache
75ba3deb0af041a9a46272ff85d9e73e Flathub pulls
f02bce89a54e4efab3a94a797d26204a Flathub pull errors
dd11929c788e48bdbb6276fb5f26b08a Boltd starting
8ddaf5ba33a74078b609250db1e951f3 Sensor state transition
""".splitlines()
)


def lookup(value: Column, table: dict) -> Column:
    """A value's entry in a literal map, null without one."""
    pairs = [F.lit(x) for k, v in table.items() for x in (str(k), v)]
    return F.try_element_at(F.create_map(*pairs), value)


def priority(value: Column) -> Column:
    return F.coalesce(lookup(value, dict(enumerate(PRIORITY_LABELS))), value)


def severity(value: Column) -> Column:
    """The colour of a row: critical up to 3, warning 4, notice 5, debug from 7, else normal."""
    n = value.try_cast("int")
    return F.when(n <= 3, "critical").when(n == 4, "warning").when(n == 5, "notice").when(n >= 7, "debug").otherwise("normal")


def facility(value: Column) -> Column:
    return F.coalesce(lookup(value, FACILITY_LABELS), value)


def error_number(value: Column) -> Column:
    name = lookup(value, errno.errorcode)
    return F.when(name.isNotNull(), F.concat(value, F.lit(" ("), name, F.lit(")"))).otherwise(value)


def message_id(value: Column, in_row: bool = True) -> Column:
    name = lookup(value, MESSAGE_NAMES)
    shown = F.concat(value, F.lit(" ("), name, F.lit(")")) if in_row else name
    return F.when(name.isNotNull(), shown).otherwise(value)


def with_message_names(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Names from a table (id, name) of any size; Spark chooses the join."""
    return df.join(names.select(F.col("id").alias(column), F.col("name").alias(name)), column, "left")


def boot(value: Column, first_usec: Column, in_row: bool = True) -> Column:
    """``id (first time)`` and two blanks in rows, the time alone in facets; the id itself if the time is unknown."""
    time = iso(first_usec)
    shown = F.concat(value, F.lit(" ("), time, F.lit(")  ")) if in_row else time
    return F.when(first_usec.isNotNull(), shown).otherwise(value)


def with_user_names(df: DataFrame, column: str, users: DataFrame) -> DataFrame:
    """Replaces numeric ids by names of a table (id, name), where it has them."""
    known = users.select(F.col("id").cast("string").alias(column), F.col("name").alias("_name"))
    return df.join(known, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name")


def capabilities(value: Column) -> Column:
    """``hex (A | B)``; raw where it is zero, not hexadecimal, or doesn't begin with a digit."""
    good = value.rlike("^[0-9][0-9a-fA-F]{0,15}$")
    bits = F.conv(F.when(good, value), 16, 10).cast("decimal(20,0)")
    names = [F.when(F.pmod(F.floor(bits / F.lit(2**k).cast("decimal(20,0)")), F.lit(2)) == 1, F.lit(n)) for k, n in enumerate(CAPABILITIES)]
    listed = F.array_join(F.array_compact(F.array(*names)), " | ")
    return F.when(good & (listed != ""), F.concat(value, F.lit(" ("), listed, F.lit(")"))).otherwise(value)


def iso(usec: Column) -> Column:
    """UTC with microseconds and Z; the session's zone is UTC."""
    return F.date_format(F.timestamp_micros(usec), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def source_time(value: Column) -> Column:
    usec = value.try_cast("bigint")
    return F.when(usec.isNotNull(), F.concat(value, F.lit(" ("), iso(usec), F.lit(")"))).otherwise(value)


def printable(value: Column) -> Column:
    """Valid UTF-8 without control characters but tab and newline."""
    text = value.cast("string")
    return F.is_valid_utf8(text) & ~text.rlike("[\\x00-\\x08\\x0B-\\x1F\\x7F-\\u009F]")


def sort_key(value: Column) -> Column:
    """Lower case without leading punctuation."""
    return F.lower(F.regexp_replace(value, r"^\p{Punct}+", ""))


def mapped_monotonic(monotonic: Column, source: Column, commit: Column) -> Column:
    """Monotonic time at the source: moved as the source time is from the commit time, 0 at least."""
    return F.greatest(F.lit(0).cast("long"), monotonic + source - commit)


class Registry:
    """Transforms by field name; a field without one is shown as it is."""

    def __init__(self, transforms: dict[str, Callable[[Column], Column]] | None = None):
        self.transforms = dict(transforms or {})

    def register(self, name: str, transform: Callable[[Column], Column]) -> Registry:
        self.transforms[name] = transform
        return self

    def show(self, name: str, value: Column) -> Column:
        return self.transforms.get(name, lambda c: c)(value)

    def apply(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Adds ``<name>__display`` for each field."""
        return df.withColumns({f"{n}__display": self.show(n, F.col(n)) for n in names})


def default_registry() -> Registry:
    return Registry({"PRIORITY": priority, "SYSLOG_FACILITY": facility, "ERRNO": error_number, "MESSAGE_ID": message_id, "_CAP_EFFECTIVE": capabilities, "_SOURCE_REALTIME_TIMESTAMP": source_time})
