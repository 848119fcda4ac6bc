"""Fixed values of the domain, and the operators that only apply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodechain.functions.text import basename, first_filled

# Images of system processes that anchor no behaviour.
NOISE_IMAGES = (
    "svchost.exe", "lsass.exe", "wmiprvse.exe", "backgroundtaskhost.exe", "msmpeng.exe", "mpcmdrun.exe", "services.exe", "csrss.exe", "smss.exe",
    "dllhost.exe", "taskhostw.exe", "searchindexer.exe", "searchprotocolhost.exe", "searchfilterhost.exe", "wininit.exe", "winlogon.exe", "sppsvc.exe",
    "fontdrvhost.exe", "wsqmcons.exe", "logonui.exe", "sihost.exe", "audiodg.exe", "consent.exe", "conhost.exe", "runtimebroker.exe",
    "applicationframehost.exe", "startmenuexperiencehost.exe", "shellexperiencehost.exe", "cortana.exe", "lockapp.exe", "securityhealthservice.exe", "securityhealthsystray.exe",
    "compattelrunner.exe", "trustedinstaller.exe", "tiworker.exe", "usoclient.exe", "siemensindustrialdcs.exe", "defender.exe", "system",
)

# Event ids of each rule category.
CATEGORY_EVENTS = {
    "process_creation": (1, 4688), "file_event": (11,), "file_change": (2,), "file_delete": (23, 26, 4660), "file_access": (4663,), "file_rename": (29,),
    "registry_event": (12, 13, 14), "registry_set": (13,), "registry_add": (12,), "registry_delete": (12,), "registry_rename": (14,),
    "network_connection": (3, 5156), "image_load": (7,), "dns_query": (22, 5158), "pipe_created": (17, 18), "process_access": (10,), "create_remote_thread": (8,),
    "create_stream_hash": (15,), "driver_load": (6,), "ps_module": (4103,), "ps_script": (4104,), "ps_classic_start": (400, 600), "raw_access_thread": (9,),
    "process_tampering": (25,), "wmi_event": (19, 20, 21), "sysmon_status": (4, 16),
}

# What the channel or source of each rule service contains.
SERVICE_CHANNEL = {
    "security": "Security", "system": "System", "application": "Application", "sysmon": "Sysmon", "powershell": "PowerShell", "powershell-classic": "PowerShell",
    "taskscheduler": "TaskScheduler", "wmi": "WMI-Activity", "ntlm": "NTLM", "dns-server": "DNS-Server", "dns-server-analytic": "DNS-Server", "applocker": "AppLocker",
    "bits-client": "Bits-Client", "smbclient-security": "SmbClient/Security", "smbserver": "SmbServer", "lsa-server": "LSA", "msexchange-management": "Exchange",
    "ldap_debug": "LDAP", "ldap-client": "LDAP", "ntfs": "Ntfs", "kernel-pnp": "Kernel-PnP", "kernel-shimengine": "Kernel-ShimEngine", "openssh": "OpenSSH",
    "windefend": "Windows Defender", "firewall-as": "Windows Firewall", "appxpackaging-om": "AppxPackaging", "appxdeployment-server": "AppXDeployment-Server",
    "appmodel-runtime": "AppModel-Runtime", "code-integrity": "CodeIntegrity", "diagnosis-scripted": "Diagnosis", "shell-core": "Shell-Core",
    "printservice-admin": "PrintService", "printservice-operational": "PrintService", "terminalservices-localsessionmanager": "TerminalServices",
    "terminalservices-remoteconnectionmanager": "TerminalServices", "wmi-activity": "WMI-Activity",
}

# Entity types that each tactic needs and gives.
TACTIC_IO = {
    "Reconnaissance": ((), ("network",)), "Resource Development": ((), ("file", "network")), "Initial Access": (("network",), ("process",)), "Execution": (("process", "file"), ("process",)),
    "Persistence": (("process",), ("file", "registry", "service")), "Privilege Escalation": (("process",), ("process", "user")), "Defense Evasion": (("process", "file"), ("process", "file", "registry")),
    "Credential Access": (("process",), ("user", "file")), "Discovery": (("process",), ("process",)), "Lateral Movement": (("user", "network"), ("process", "network")), "Collection": (("process", "file"), ("file",)),
    "Command and Control": (("process",), ("network",)), "Exfiltration": (("file", "network"), ("network",)), "Impact": (("process",), ("file", "process", "service")),
}

# Entity type and direction of each data component.
DATA_COMPONENTS = {
    "Process Creation": ("process", "out"), "Process Access": ("process", "in"), "Process Metadata": ("process", "in"), "Process Modification": ("process", "out"), "Process Termination": ("process", "out"),
    "Command Execution": ("process", "both"), "Script Execution": ("process", "both"), "OS API Execution": ("process", "in"), "Module Load": ("process", "in"),
    "File Access": ("file", "in"), "File Creation": ("file", "out"), "File Deletion": ("file", "out"), "File Metadata": ("file", "in"), "File Modification": ("file", "out"), "Firmware Modification": ("file", "out"),
    "Windows Registry Key Access": ("registry", "in"), "Windows Registry Key Creation": ("registry", "out"), "Windows Registry Key Modification": ("registry", "out"),
    "Network Connection Creation": ("network", "out"), "Network Traffic Content": ("network", "both"), "Network Traffic Flow": ("network", "both"), "Network Share Access": ("network", "in"), "Firewall Rule Modification": ("network", "out"), "Domain Registration": ("network", "out"),
    "Service Creation": ("service", "out"), "Service Metadata": ("service", "in"), "Service Modification": ("service", "out"), "Scheduled Job Creation": ("service", "out"), "Scheduled Job Metadata": ("service", "in"), "Scheduled Job Modification": ("service", "out"), "WMI Creation": ("service", "out"), "Driver Load": ("service", "in"),
    "User Account Authentication": ("user", "in"), "User Account Creation": ("user", "out"), "User Account Deletion": ("user", "out"), "User Account Metadata": ("user", "in"), "User Account Modification": ("user", "out"), "Logon Session Creation": ("user", "out"), "Logon Session Metadata": ("user", "in"), "Web Credential Creation": ("user", "out"),
    "Active Directory Credential Request": ("user", "in"), "Active Directory Object Access": ("user", "in"), "Active Directory Object Creation": ("user", "out"), "Active Directory Object Deletion": ("user", "out"), "Active Directory Object Modification": ("user", "out"),
    "Drive Access": ("file", "in"), "Drive Creation": ("file", "out"), "Drive Modification": ("file", "out"), "Volume Creation": ("file", "out"),
    "Named Pipe Metadata": ("process", "in"), "Application Log Content": ("file", "in"), "Host Status": ("process", "in"), "Cloud Service Metadata": ("network", "in"), "Cloud Storage Access": ("network", "in"),
}


def noise_anchor(*images: str) -> Column:
    """Whether any of the image columns names a system process; blank and null ones do not."""
    one = lambda c: F.coalesce(F.lower(basename(first_filled(F.col(c)))).isin(*NOISE_IMAGES), F.lit(False))
    return reduce(Column.__or__, map(one, images), F.lit(False))


def log_source(source: dict) -> Column:
    """Whether an event can come from a rule's log source; unknown categories and services let all pass."""
    product = str(source.get("product") or "").lower()
    tests = [F.lit(product in ("", "windows"))]
    if (events := CATEGORY_EVENTS.get(str(source.get("category") or "").lower())) is not None:
        tests.append(F.coalesce(F.col("EventID").isin(*events), F.lit(False)))
    if channel := SERVICE_CHANNEL.get(str(source.get("service") or "").lower()):
        tests.append(F.lower(F.concat_ws(" ", F.coalesce("Channel", F.lit("")), F.coalesce("SourceName", F.lit("")))).contains(channel.lower()))
    return reduce(Column.__and__, tests)


def technique_io(catalogue: DataFrame, log_sources: str = "log_sources") -> DataFrame:
    """(technique_id, inputs, outputs) from a JSON list of data components; unknown components give nothing."""
    spark = catalogue.sparkSession
    known = spark.createDataFrame([(k, e, d) for k, (e, d) in DATA_COMPONENTS.items()], "component string, entity string, direction string")
    parts = catalogue.select("technique_id", F.explode(F.from_json(log_sources, "array<map<string,string>>")).alias("m"))
    named = parts.select("technique_id", F.trim(F.substring_index(F.col("m")["Data Component"], "(DC", 1)).alias("component"))
    j = named.join(F.broadcast(known), "component")
    side = lambda d: F.sort_array(F.collect_set(F.when(F.col("direction").isin(d, "both"), F.col("entity"))))
    return j.groupBy("technique_id").agg(side("in").alias("inputs"), side("out").alias("outputs"))


def tactic_io(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(i), list(o)) for k, (i, o) in TACTIC_IO.items()], "tactic string, inputs array<string>, outputs array<string>")


def with_io(steps: DataFrame, techniques: DataFrame) -> DataFrame:
    """``steps`` (technique_id, tactic) with inputs and outputs: the technique's, else its tactic's, else none."""
    t = F.broadcast(tactic_io(steps.sparkSession).withColumnsRenamed({"inputs": "__i", "outputs": "__o"}))
    j = steps.join(F.broadcast(techniques), "technique_id", "left").join(t, "tactic", "left")
    empty = F.array().cast("array<string>")
    return j.withColumns({"inputs": F.coalesce("inputs", "__i", empty), "outputs": F.coalesce("outputs", "__o", empty)}).drop("__i", "__o")


def object_id() -> Column:
    """What an event acts on, by its family; texts are cut at 120 characters."""
    eid, s = F.col("EventID"), lambda c: F.coalesce(F.col(c), F.lit(""))
    host = F.coalesce(F.nullif(F.col("DestinationHostname"), F.lit("")), F.nullif(F.col("DestinationIp"), F.lit("")))
    return (
        F.when(eid.isin(1, 4688), s("Image"))
        .when(eid.isin(2, 11, 23, 26), s("TargetFilename"))
        .when(eid.isin(12, 13, 14), s("TargetObject"))
        .when(eid == 3, F.coalesce(F.concat(host, F.lit(":"), s("DestinationPort")), F.lit("")))
        .when(eid == 22, s("QueryName"))
        .when(eid == 7, s("ImageLoaded"))
        .when(eid.isin(8, 10), s("TargetImage"))
        .when(eid.isin(17, 18), s("PipeName"))
        .when(eid.isin(4624, 4625, 4634, 4648, 4672), F.coalesce(first_filled(F.col("TargetUserName"), F.col("SubjectUserName")), F.lit("")))
        .when(eid == 4663, s("ObjectName"))
        .when(eid == 4104, F.substring(s("ScriptBlockText"), 1, 120))
        .when(eid == 7045, s("ServiceName"))
        .otherwise(F.substring(s("Message"), 1, 120))
    )
