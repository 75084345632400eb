"""Fixed values shared by the operators: keyword lists, lookup tables and bands.

Everything here is data.  Operators take these tables as parameters, so a caller
can pass their own; the values below are the defaults results depend on.
"""

# --- fixed values: severity words -----------------------------------------------------

LEVEL_WORDS = {
    "ERROR": ["error", "exception", "critical", "fatal"],
    "WARN": ["warn"],
}

# --- fixed values: threat keywords, batch feature dictionary --------------------------

BATCH_KEYWORDS = {
    "brute_force": [
        "failed", "invalid", "wrong password", "authentication failure",
        "login failed", "bad credentials",
    ],
    "privilege_esc": [
        "privilege", "escalation", "sudo", "root", "admin", "elevated",
        "permission denied", "unauthorized",
    ],
    "dos": [
        "flood", "overload", "too many requests", "rate limit",
        "connection refused", "timeout",
    ],
    "log_tamper": ["deleted", "modified", "cleared", "truncated", "log rotation"],
    "startup": [
        "startup", "boot", "init", "service start", "autorun",
        "scheduled task", "cron",
    ],
    "network": [
        "port scan", "ssh", "firewall", "connection attempt", "remote", "intrusion",
    ],
}

# --- fixed values: threat keywords, real-time dictionary ------------------------------

REALTIME_KEYWORDS = {
    "brute_force": [
        "failed", "invalid", "wrong password", "authentication failure",
        "login failed", "bad credentials", "failurereason", "logon failure",
        "logonfailure", "0xc000006d", "0xc0000064", "0xc000006a", "0xc0000071",
        "keywords=failed logon",
    ],
    "privilege_esc": [
        "privilege", "escalation", "sudo", "root", "elevated",
        "permission denied", "unauthorized", "newaccountsam", "membershipchanged",
        "membersid", "targetusername=sentinelprobe", "targetusername=admin",
        "keywords=user account created", "keywords=member added",
    ],
    "dos": [
        "flood", "overload", "too many requests", "rate limit",
        "connection refused", "timeout",
    ],
    "log_tamper": [
        "deleted", "modified", "cleared", "truncated", "log rotation",
        "keywords=audit log cleared", "subjectusername=system",
        "channel=security level=log time",
    ],
    "startup": [
        "startup", "boot", "init", "service start", "autorun", "scheduled task",
        "cron", "taskname", "taskcontenttext", "encodedcommand",
        "windowsstyle hidden", "executionpolicy bypass",
        "keywords=scheduled task created",
    ],
    "network": [
        "port scan", "ssh", "firewall", "connection attempt", "remote", "intrusion",
    ],
    "suspicious_process": [
        "encodedcommand", "executionpolicy bypass", "windowsstyle hidden",
        "noprofile", "noninteractive", "downloadstring", "amsiutils",
        "invoke-expression", "iex ", "-enc ", "hidden",
    ],
}

# --- fixed values: weighted attack phrases --------------------------------------------

ATTACK_WEIGHTS = {
    "failed login": 5.5,
    "authentication failed": 5.5,
    "invalid password": 5.0,
    "invalid credentials": 5.0,
    "login failed": 5.5,
    "failed": 2.5,
    "unauthorized": 6.0,
    "access denied": 6.0,
    "permission denied": 5.5,
    "forbidden": 5.0,
    "denied": 4.0,
    "privilege escalation": 7.5,
    "sudo": 2.0,
    "root access": 6.5,
    "admin access": 5.0,
    "sql injection": 8.5,
    "xss": 8.0,
    "script injection": 8.0,
    "command injection": 8.5,
    "exploit": 7.5,
    "payload": 6.5,
    "brute force": 8.0,
    "multiple failed": 7.0,
    "repeated attempts": 7.0,
    "malware": 9.0,
    "ransomware": 9.5,
    "trojan": 9.0,
    "log tamper": 8.5,
    "modified log": 8.5,
    "port scan": 7.0,
    "intrusion": 7.5,
    "suspicious ip": 6.5,
    "error": 1.5,
    "attack": 7.0,
    "warning": 1.0,
}

CUSTOM_TEMPLATE_BONUS = 3.0
SCORE_CEILING = 10.0

# (lowest score, inclusive) -> band; anything above zero is LOW, zero is NONE
SCORE_BANDS = [(9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM")]

# --- fixed values: Windows event tables -----------------------------------------------

EVENT_THREATS = {
    4625: "brute_force",
    4648: "brute_force",
    4720: "privilege_esc",
    4728: "privilege_esc",
    4732: "privilege_esc",
    4756: "privilege_esc",
    4698: "startup",
    4702: "startup",
    7045: "startup",
    1102: "log_tamper",
    4719: "log_tamper",
    4657: "privilege_esc",
}

EVENT_TEMPLATES = {
    4624: "successful_logon",
    4625: "failed_logon",
    4634: "logoff",
    4648: "explicit_credential_logon",
    4656: "object_handle_request",
    4657: "registry_value_modified",
    4663: "object_access_attempt",
    4672: "special_privilege_logon",
    4688: "process_created",
    4698: "scheduled_task_created",
    4702: "scheduled_task_updated",
    4719: "audit_policy_changed",
    4720: "user_account_created",
    4722: "user_account_enabled",
    4723: "password_change_attempt",
    4724: "password_reset",
    4725: "user_account_disabled",
    4728: "member_added_global_group",
    4732: "member_added_local_group",
    4740: "account_locked_out",
    4756: "member_added_universal_group",
    4768: "kerberos_tgt_request",
    4769: "kerberos_service_request",
    4771: "kerberos_preauth_failed",
    4776: "credential_validation",
    4798: "user_local_group_enumerated",
    4799: "local_group_membership_enumerated",
    1102: "audit_log_cleared",
    7034: "service_crashed",
    7035: "service_control_request",
    7045: "new_service_installed",
}

EVENT_KEYWORDS = {
    4624: "successful logon authentication",
    4625: "failed logon authentication failure brute force",
    4648: "explicit logon credentials used brute force",
    4634: "logoff session ended",
    4647: "user initiated logoff",
    4800: "workstation locked screen lock",
    4801: "workstation unlocked screen unlock",
    4672: "special privileges assigned admin elevation",
    4703: "token right adjusted privilege escalation",
    4674: "operation attempted on privileged object",
    4688: "process created new process execution",
    4689: "process terminated",
    4698: "scheduled task created persistence autorun startup",
    4699: "scheduled task deleted",
    4702: "scheduled task updated",
    7034: "service crashed unexpected termination",
    7036: "service state changed started stopped",
    7040: "service start type changed persistence",
    7045: "new service installed persistence",
    4720: "user account created privilege escalation admin",
    4722: "user account enabled",
    4723: "password change attempt",
    4724: "password reset attempt",
    4725: "user account disabled",
    4726: "user account deleted",
    4728: "member added security group privilege escalation",
    4732: "member added Administrators group privilege escalation admin",
    4756: "member added universal security group",
    4738: "user account changed",
    4740: "user account locked out brute force",
    4768: "kerberos ticket requested authentication",
    4769: "kerberos service ticket requested",
    4771: "kerberos pre-authentication failed brute force",
    4776: "credential validation NTLM authentication",
    1102: "audit log cleared log deleted cover tracks",
    4616: "system time changed clock manipulation",
    4657: "registry value modified persistence",
    4719: "audit policy modified system policy changed",
    4826: "boot configuration changed bootkit",
    4663: "object access attempt file folder delete",
    5140: "network share accessed lateral movement",
    5142: "network share added persistence",
    5143: "network share modified",
    5144: "network share deleted",
    4946: "firewall rule added",
    4947: "firewall rule modified",
    4948: "firewall rule deleted",
    4950: "firewall setting changed",
    4778: "remote desktop session reconnected",
    4779: "remote desktop session disconnected",
    1149: "remote desktop authentication succeeded",
    4103: "powershell pipeline execution script",
    4104: "powershell script block logging execution",
    6416: "new device plugged in USB external storage",
    1000: "application crashed unexpected error",
    1001: "windows error reporting crash",
}

EVENT_LEVELS = {"1": "CRITICAL", "2": "ERROR", "3": "WARNING", "4": "INFO", "0": "LOG"}

CHANNELS = ["Security", "System", "Application"]

# --- fixed values: file-name and content hints of the log formats ---------------------

SUPPORTED_SUFFIXES = [".log", ".txt", ".csv", ".gz"]

FORMAT_NAME_HINTS = [
    ("hdfs", ["hdfs", "hadoop"]),
    ("syslog", ["syslog", "auth", "kern", "messages", "secure"]),
    ("winlog", ["security", "system", "application", "winevt", "winlog"]),
]

FORMAT_TEXT_HINTS = [
    ("hdfs", r"blk_|namenode|datanode"),
    ("syslog", r"\b(sshd|sudo|su|pam|kernel)\b"),
    ("winlog", r"eventid|logname"),
]

FORMAT_OS = {"winlog": "windows", "syslog": "linux", "hdfs": "linux"}

# --- fixed values: CSV export headers, first present name wins ------------------------

WINLOG_CSV_HEADERS = {
    "time": ["TimeCreated", "Date and Time"],
    "level": ["LevelDisplayName", "Level"],
    "event": ["Id", "Event ID"],
    "message": ["Message", "Description"],
}

# --- fixed values: rule table (category, priority, hits needed) -----------------------

RULES = [
    ("brute_force", "HIGH", 3),
    ("privilege_esc", "HIGH", 1),
    ("startup", "HIGH", 1),
    ("log_tamper", "CRITICAL", 1),
    ("suspicious_process", "MEDIUM", 2),
    ("dos", "MEDIUM", 5),
    ("network", "LOW", 5),
]

PRIORITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
PRIORITY_CVSS = {"CRITICAL": 9.5, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.0}
PRIORITY_CVSS_FLOOR = {"CRITICAL": 9.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 0.0}

# --- fixed values: analyst labels and ground truth ------------------------------------

ANALYST_LABELS = ["true_positive", "false_positive", "true_negative", "false_negative"]

FEEDBACK_SIGN = {
    "true_positive": -1,
    "false_positive": 1,
    "true_negative": 1,
    "false_negative": -1,
}

TRUTH_SIGN = {"Normal": 1, "Anomaly": -1}

# --- fixed values: model input --------------------------------------------------------

MODEL_FEATURES = [
    "num_events", "unique_templates", "avg_msg_len", "std_msg_len", "max_msg_len",
    "min_msg_len", "error_count", "warn_count", "info_count", "error_ratio",
    "warn_ratio", "template_entropy", "top_template_ratio", "block_duration_sec",
    "events_per_sec", "gap_count", "brute_force_hits", "privilege_esc_hits",
    "dos_hits", "log_tamper_hits", "startup_hits", "network_hits",
]

NON_FEATURES = ["block_id", "label", "anomaly", "split"]
NON_FEATURES_EVALUATION = ["block_id", "BlockId", "Label", "label", "anomaly", "split"]

COLUMN_ALIASES = {
    "block_duration": "block_duration_sec",
    "block_duration_sec": "block_duration",
}

# --- fixed values: vulnerability dimension by threat category -------------------------

CVE_BY_CATEGORY = {
    "brute_force": {
        "cve_ids": ["CVE-2019-0708", "CVE-2019-1182", "CVE-2022-21907"],
        "cwe": "CWE-307",
        "name": "Brute Force / Credential Attack",
        "description": (
            "Multiple failed logon attempts detected. CVE-2019-0708 (BlueKeep) and "
            "CVE-2019-1182 (DejaBlue) are critical RDP vulnerabilities exploited through "
            "repeated authentication attempts that can lead to remote code execution."
        ),
        "tip": (
            "1. Enable account lockout policy (lock after 5 failed attempts, 30-min lockout). "
            "2. Enforce multi-factor authentication (MFA) for all accounts. "
            "3. Restrict RDP access to known IPs via Windows Firewall. "
            "4. Rename the built-in Administrator account. "
            "5. Apply Windows security updates — patch CVE-2019-0708 immediately if unpatched."
        ),
    },
    "privilege_esc": {
        "cve_ids": ["CVE-2021-34527", "CVE-2020-1472", "CVE-2021-36934", "CVE-2022-37969"],
        "cwe": "CWE-269",
        "name": "Privilege Escalation",
        "description": (
            "Unauthorized elevation of privileges detected. CVE-2021-34527 (PrintNightmare) "
            "allows SYSTEM-level code execution via Print Spooler. CVE-2020-1472 (Zerologon) "
            "allows full domain compromise via Netlogon. CVE-2021-36934 (HiveNightmare) "
            "exposes SAM database to low-privilege users."
        ),
        "tip": (
            "1. Apply the principle of least privilege — audit and trim administrator group "
            "membership now. "
            "2. Install all pending Windows security patches immediately (patch PrintNightmare, "
            "Zerologon). "
            "3. Disable Print Spooler on Domain Controllers if not needed. "
            "4. Enable Windows Defender Credential Guard. "
            "5. Review all accounts added to Administrators group in the last 24 hours."
        ),
    },
    "startup": {
        "cve_ids": ["CVE-2019-1069", "CVE-2022-21999", "CVE-2023-21768"],
        "cwe": "CWE-693",
        "name": "Persistence / Scheduled Task Abuse",
        "description": (
            "Suspicious scheduled task or service creation detected. CVE-2019-1069 allows "
            "privilege escalation via Windows Task Scheduler. Attackers use scheduled tasks "
            "as a persistence mechanism to survive reboots and maintain access."
        ),
        "tip": (
            "1. Audit all scheduled tasks immediately: run 'schtasks /query /fo LIST /v' as admin. "
            "2. Delete any unrecognised tasks, especially those running PowerShell or encoded "
            "commands. "
            "3. Restrict who can create scheduled tasks via Group Policy "
            "   (Computer Configuration → Windows Settings → Security Settings → User Rights). "
            "4. Enable Task Scheduler event logging (Event ID 4698/4699). "
            "5. Use AppLocker or WDAC to prevent unauthorised executables from running."
        ),
    },
    "log_tamper": {
        "cve_ids": ["CVE-2021-31166", "CVE-2022-26809"],
        "cwe": "CWE-778",
        "name": "Log Tampering / Audit Trail Destruction",
        "description": (
            "Security event log was cleared (Event ID 1102/104). This is a classic attacker "
            "technique to erase evidence of compromise."
        ),
        "tip": (
            "1. Forward all logs to a remote SIEM/log server — local clearing cannot affect "
            "off-machine copies. "
            "2. Investigate what happened BEFORE the log was cleared. "
            "3. Restrict 'Manage auditing and security log' user right to Administrators only. "
            "4. Enable Windows Event Forwarding (WEF) to ship logs to a collector in real time. "
            "5. Treat log clearing as a confirmed breach indicator — begin incident response."
        ),
    },
    "suspicious_process": {
        "cve_ids": ["CVE-2022-30190", "CVE-2021-40444", "CVE-2021-26855"],
        "cwe": "CWE-78",
        "name": "Malicious Process / Living-off-the-Land Attack",
        "description": (
            "Suspicious PowerShell or process execution detected. CVE-2022-30190 (Follina) "
            "enables remote code execution via MSDT. CVE-2021-40444 exploits MSHTML "
            "via Office documents. Attackers use built-in tools (LOLBins) to evade AV detection."
        ),
        "tip": (
            "1. Enable PowerShell Script Block Logging and Transcription "
            "   (Group Policy → Administrative Templates → Windows Components → PowerShell). "
            "2. Set PowerShell Execution Policy to 'AllSigned' or 'RemoteSigned'. "
            "3. Enable AMSI (Antimalware Scan Interface) — ensure Windows Defender is active. "
            "4. Use AppLocker to block unsigned scripts and executables. "
            "5. Patch CVE-2022-30190 (Follina): disable MSDT URL protocol or apply KB5014699."
        ),
    },
    "dos": {
        "cve_ids": ["CVE-2021-31166", "CVE-2022-34691", "CVE-2022-26809"],
        "cwe": "CWE-400",
        "name": "Denial of Service / Resource Exhaustion",
        "description": (
            "Flood or resource exhaustion pattern detected. CVE-2021-31166 is a critical "
            "Windows HTTP Protocol Stack vulnerability exploitable for DoS and RCE. "
            "High connection rates can overwhelm services and cause system instability."
        ),
        "tip": (
            "1. Enable Windows Firewall rate limiting rules to block IPs with excessive "
            "connections. "
            "2. Apply CVE-2021-31166 patch (KB5003173) if IIS/HTTP.sys is exposed. "
            "3. Use a WAF or DDoS protection service (Azure DDoS Protection, Cloudflare) "
            "   in front of publicly exposed services. "
            "4. Configure IIS connection limits and request throttling. "
            "5. Monitor and alert on connections-per-second thresholds."
        ),
    },
    "network": {
        "cve_ids": ["CVE-2021-31166", "CVE-2022-26809", "CVE-2023-23397"],
        "cwe": "CWE-200",
        "name": "Network Reconnaissance / Lateral Movement",
        "description": (
            "Network scanning or enumeration activity detected. CVE-2023-23397 is a critical "
            "zero-click Outlook vulnerability used for credential theft via UNC paths. "
            "Reconnaissance is the first stage of a targeted attack."
        ),
        "tip": (
            "1. Implement network segmentation — isolate sensitive systems behind VLANs. "
            "2. Block outbound SMB (port 445) at the perimeter firewall. "
            "3. Patch CVE-2023-23397 (Outlook) — apply March 2023 security update. "
            "4. Deploy a Host-based IDS (e.g., Windows Defender for Endpoint) to detect "
            "   lateral movement patterns. "
            "5. Audit network shares (net share) and remove any unnecessary open shares."
        ),
    },
}

# --- fixed values: vulnerability dimension by Windows event id ------------------------

CVE_BY_EVENT = {
    4625: {
        "cve_ids": ["CVE-2019-0708", "CVE-2019-1182"],
        "cwe": "CWE-307",
        "name": "Failed Logon (Brute Force Attempt)",
        "description": (
            "Windows failed logon. Repeated failures indicate a brute-force or "
            "password-spray attack."
        ),
        "tip": "Enable account lockout, enforce MFA, restrict RDP to known IPs.",
    },
    4720: {
        "cve_ids": ["CVE-2020-1472", "CVE-2021-36934"],
        "cwe": "CWE-269",
        "name": "New User Account Created",
        "description": (
            "A new local user account was created — possible attacker backdoor account."
        ),
        "tip": (
            "Verify the account is legitimate. Delete if unrecognised. Audit who has "
            "'Create accounts' rights."
        ),
    },
    4728: {
        "cve_ids": ["CVE-2021-34527", "CVE-2020-1472"],
        "cwe": "CWE-269",
        "name": "User Added to Security Group",
        "description": (
            "A user was added to a privileged security group — possible privilege escalation."
        ),
        "tip": (
            "Verify the change is authorised. Remove if not. Review group membership policy."
        ),
    },
    4732: {
        "cve_ids": ["CVE-2021-34527", "CVE-2022-37969"],
        "cwe": "CWE-269",
        "name": "User Added to Administrators Group",
        "description": (
            "A user was added to the local Administrators group — high-severity privilege "
            "escalation."
        ),
        "tip": (
            "Remove the account immediately if not authorised. Rotate all admin credentials. "
            "Review UAC settings."
        ),
    },
    4698: {
        "cve_ids": ["CVE-2019-1069", "CVE-2023-21768"],
        "cwe": "CWE-693",
        "name": "Scheduled Task Created (Persistence)",
        "description": (
            "A new scheduled task was created — commonly used by malware for persistence."
        ),
        "tip": (
            "Review the task in Task Scheduler. Delete if unrecognised. Block task creation "
            "via Group Policy for non-admins."
        ),
    },
    1102: {
        "cve_ids": [],
        "cwe": "CWE-778",
        "name": "Security Log Cleared",
        "description": (
            "The Windows Security audit log was cleared — attackers do this to hide evidence."
        ),
        "tip": (
            "Treat as active breach. Enable log forwarding immediately. Investigate all "
            "activity before the clear event."
        ),
    },
    4719: {
        "cve_ids": [],
        "cwe": "CWE-778",
        "name": "Audit Policy Modified",
        "description": (
            "Windows audit policy was changed — attackers disable auditing to avoid detection."
        ),
        "tip": (
            "Restore audit policy via Group Policy. Investigate who changed it and when."
        ),
    },
}

CVE_GENERIC = {
    "cve_ids": [],
    "cwe": "CWE-693",
    "name": "Security Anomaly Detected",
    "description": "An anomalous pattern was detected in system event logs.",
    "tip": (
        "Review recent system activity. Check Event Viewer for unusual entries. "
        "Ensure all Windows updates are applied. Run a full antivirus scan."
    ),
}
