"""The lexical vocabulary of the server's SQL dialect: words, token ids and spellings.

The numbers are facts of the protocol (a digest hashes token ids) and were transcribed as data; see NOTICE. Words are
listed backwards by spelling; ``word=id``.
"""

from __future__ import annotations

#: Words and operators of all versions but those that only 5.7 has.
_WORDS = """
||=644 ZONE=1157 ZEROFILL=906 YEAR_MONTH=904 YEAR=905 XOR=903 XML=902 XID=901 XA=900 X509=899 WRITE=898 WRAPPER=897 WORK=896 WITHOUT=895 WITH=892
WINDOW=953 WHILE=891 WHERE=890 WHEN=889 WEIGHT_STRING=888 WEEK=887 WARNINGS=886 WAIT=885 VISIBLE=912 VIRTUAL=884 VIEW=883 VERIFY_KEY_CONSTRAINTS=1232
VECTOR=1215 VCPU=965 VAR_SAMP=882 VAR_POP=880 VARYING=881 VARIANCE=880 VARIABLES=879 VARCHARACTER=878 VARCHAR=878 VARBINARY=877 VALUES=875 VALUE=876
VALIDATION=874 VALIDATE=1239 UTC_TIMESTAMP=872 UTC_TIME=873 UTC_DATE=871 USING=870 USE_FRM=868 USER_RESOURCES=723 USER=867 USE=869 USAGE=866 URL=1202
URI=1219 UPGRADE=865 UPDATE=864 UNTIL=863 UNSIGNED=862 UNREGISTER=1196 UNLOCK=861 UNKNOWN=860 UNIQUE=859 UNION=858 UNINSTALL=857 UNICODE=856
UNDO_BUFFER_SIZE=854 UNDOFILE=853 UNDO=855 UNDEFINED=851 UNCOMMITTED=850 UNBOUNDED=952 TYPES=846 TYPE=847 TRUNCATE=845 TRUE=844 TRIM=843 TRIGGERS=841
TRIGGER=842 TRANSACTION=840 TRAILING=839 TO=838 TLS=1152 TINYTEXT=837 TINYINT=836 TINYBLOB=835 TIMESTAMPDIFF=833 TIMESTAMPADD=832 TIMESTAMP=831
TIME=834 TIES=951 THREAD_PRIORITY=962 THEN=830 THAN=829 TEXT=828 TERMINATED=826 TEMPTABLE=825 TEMPORARY=824 TABLE_NAME=823 TABLE_CHECKSUM=822
TABLESPACE=819 TABLESAMPLE=1214 TABLES=818 TABLE=821 SYSTEM_USER=867 SYSTEM=964 SYSDATE=817 SWITCHES=816 SWAPS=815 SUSPEND=814 SUPER=813 SUM=812
SUBSTRING=811 SUBSTR=811 SUBQUERY=1018 SUBPARTITIONS=809 SUBPARTITION=810 SUBJECT=808 SUBDATE=807 SUBCLASS_ORIGIN=806 ST_COLLECT=1189 STRING=805
STRICT_LOAD=1233 STREAM=997 STRAIGHT_JOIN=804 STORED=803 STORAGE=802 STOP=801 STDDEV_SAMP=799 STDDEV_POP=800 STDDEV=800 STD=800 STATUS=798
STATS_SAMPLE_PAGES=797 STATS_PERSISTENT=796 STATS_AUTO_RECALC=795 STARTS=793 STARTING=792 START=794 STACKED=791 SSL=790 SRID=961 SQL_TSI_YEAR=905
SQL_TSI_WEEK=887 SQL_TSI_SECOND=746 SQL_TSI_QUARTER=682 SQL_TSI_MONTH=601 SQL_TSI_MINUTE=594 SQL_TSI_HOUR=481 SQL_TSI_DAY=375 SQL_THREAD=789
SQL_SMALL_RESULT=787 SQL_NO_CACHE=786 SQL_CALC_FOUND_ROWS=785 SQL_BUFFER_RESULT=783 SQL_BIG_RESULT=782 SQL_BEFORE_GTIDS=781 SQL_AFTER_MTS_GAPS=780
SQL_AFTER_GTIDS=779 SQLWARNING=778 SQLSTATE=777 SQLEXCEPTION=776 SQL=788 SPECIFIC=775 SPATIAL=774 SOURCE_ZSTD_COMPRESSION_LEVEL=1188 SOURCE_USER=1187
SOURCE_TLS_VERSION=1186 SOURCE_TLS_CIPHERSUITES=1185 SOURCE_SSL_VERIFY_SERVER_CERT=1184 SOURCE_SSL_KEY=1183 SOURCE_SSL_CRLPATH=1182
SOURCE_SSL_CRL=1181 SOURCE_SSL_CIPHER=1180 SOURCE_SSL_CERT=1179 SOURCE_SSL_CAPATH=1178 SOURCE_SSL_CA=1177 SOURCE_SSL=1176 SOURCE_RETRY_COUNT=1175
SOURCE_PUBLIC_KEY_PATH=1174 SOURCE_PORT=1173 SOURCE_PASSWORD=1172 SOURCE_LOG_POS=1171 SOURCE_LOG_FILE=1170 SOURCE_HOST=1169
SOURCE_HEARTBEAT_PERIOD=1168 SOURCE_DELAY=1167 SOURCE_CONNECT_RETRY=1166 SOURCE_CONNECTION_AUTO_FAILOVER=1156 SOURCE_COMPRESSION_ALGORITHMS=1165
SOURCE_BIND=1164 SOURCE_AUTO_POSITION=1163 SOURCE=773 SOUNDS=772 SONAME=771 SOME=275 SOCKET=770 SNAPSHOT=769 SMALLINT=768 SLOW=767 SLAVE=766
SKIP_SCAN=1028 SKIP=923 SIMPLE=765 SIGNED=764 SIGNAL=763 SHUTDOWN=762 SHOW=761 SHARE=758 SET_VAR=1027 SETS=1238 SET=756 SESSION_USER=867 SESSION=753
SERVER=754 SERIALIZABLE=751 SERIAL=752 SEPARATOR=750 SENSITIVE=749 SEMIJOIN=1017 SELECT=748 SECURITY=747 SECOND_MICROSECOND=745 SECONDARY_UNLOAD=982
SECONDARY_LOAD=981 SECONDARY_ENGINE_ATTRIBUTE=1155 SECONDARY_ENGINE=980 SECONDARY=979 SECOND=746 SCHEMA_NAME=744 SCHEMAS=364 SCHEMA=363 SCHEDULE=743
SAVEPOINT=742 S3=1209 RTREE=741 ROW_NUMBER=950 ROW_FORMAT=738 ROW_COUNT=740 ROWS=737 ROW=739 ROUTINE=736 ROTATE=735 ROLLUP=734 ROLLBACK=733 ROLE=909
RLIKE=697 RIGHT=732 REVOKE=731 REVERSE=730 REUSE=960 RETURNS=728 RETURNING=999 RETURNED_SQLSTATE=727 RETURN=729 RETAIN=983 RESUME=726 RESTRICT=725
RESTORE=724 RESTART=968 RESPECT=949 RESOURCE_GROUP=1001 RESOURCE=963 RESIGNAL=722 RESET=721 REQUIRE_TABLE_PRIMARY_KEY_CHECK=996 REQUIRE_ROW_FORMAT=993
REQUIRE=720 REPLICATION=712 REPLICATE_WILD_IGNORE_TABLE=718 REPLICATE_WILD_DO_TABLE=717 REPLICATE_REWRITE_DB=719 REPLICATE_IGNORE_TABLE=716
REPLICATE_IGNORE_DB=714 REPLICATE_DO_TABLE=715 REPLICATE_DO_DB=713 REPLICAS=1160 REPLICA=1159 REPLACE=711 REPEATABLE=709 REPEAT=710 REPAIR=708
REORGANIZE=707 RENAME=706 REMOVE=705 RELOAD=704 RELEASE=703 RELAY_THREAD=702 RELAY_LOG_POS=701 RELAY_LOG_FILE=700 RELAYLOG=699 RELAY=698
RELATIONAL=1221 REGISTRATION=1195 REGEXP=697 REFERENCES=696 REFERENCE=972 REDUNDANT=695 REDO_BUFFER_SIZE=694 RECURSIVE=915 RECOVER=692 REBUILD=691
REAL=690 READ_WRITE=689 READ_ONLY=687 READS=686 READ=688 RANK=948 RANGE=685 RANDOM=988 QUICK=684 QUERY=683 QUARTER=682 QUALIFY=1210 QB_NAME=1016
PURGE=681 PROXY=680 PROFILES=679 PROFILE=678 PROCESSLIST=677 PROCESS=676 PROCEDURE=675 PRIVILEGE_CHECKS_USER=991 PRIVILEGES=674 PRIMARY=673 PREV=672
PRESERVE=671 PREPARE=670 PRECISION=669 PRECEDING=947 PRECEDES=668 POSITION=667 PORT=666 POLYGON=665 POINT=664 PLUGIN_DIR=661 PLUGINS=663 PLUGIN=662
PHASE=660 PERSIST_ONLY=927 PERSIST=908 PERCENT_RANK=946 PATH=958 PASSWORD_LOCK_TIME=994 PASSWORD=659 PARTITIONS=657 PARTITIONING=658 PARTITION=656
PARTIAL=655 PARSE_TREE=1205 PARSER=653 PARAMETERS=1216 PARALLEL=1208 PAGE=651 PACK_KEYS=650 OWNER=649 OVER=945 OUTFILE=647 OUTER=646 OUT=648
OTHERS=944 ORGANIZATION=971 ORDINALITY=957 ORDER_INDEX=1045 ORDER=643 OR=645 OPTIONS=639 OPTIONALLY=641 OPTIONAL=978 OPTION=640 OPTIMIZER_COSTS=638
OPTIMIZE=637 OPEN=636 ONLY=635 ONE=634 ON=633 OLD=984 OJ=986 OFFSET=632 OFF=998 OF=922 NVARCHAR=631 NUMERIC=630 NUMBER=629 NULLS=943 NULL=627
NTILE=942 NTH_VALUE=941 NO_WRITE_TO_BINLOG=626 NO_WAIT=625 NO_SKIP_SCAN=1029 NO_SEMIJOIN=1014 NO_RANGE_OPTIMIZATION=1013 NO_ORDER_INDEX=1046
NO_MRR=1012 NO_MERGE=1020 NO_JOIN_INDEX=1042 NO_INDEX_MERGE=1026 NO_INDEX=1040 NO_ICP=1011 NO_HASH_JOIN=1031 NO_GROUP_INDEX=1044
NO_DERIVED_CONDITION_PUSHDOWN=1048 NO_BNL=1010 NO_BKA=1009 NOWAIT=925 NOW=623 NOT=622 NONE=620 NODEGROUP=619 NO=624 NEXT=618 NEW=617 NEVER=616
NETWORK_NAMESPACE=987 NESTED=956 NDBCLUSTER=613 NDB=613 NCHAR=612 NATURAL=610 NATIONAL=609 NAMES=607 NAME=608 MYSQL_ERRNO=606 MUTEX=605
MULTIPOLYGON=604 MULTIPOINT=603 MULTILINESTRING=602 MRR=1015 MONTH=601 MODIFY=599 MODIFIES=598 MODE=597 MOD=600 MIN_ROWS=595 MINUTE_SECOND=593
MINUTE_MICROSECOND=592 MINUTE=594 MIN=596 MIGRATE=591 MIDDLEINT=584 MID=811 MICROSECOND=590 MESSAGE_TEXT=589 MERGE=588 MEMORY=587 MEMBER=977
MEDIUMTEXT=585 MEDIUMINT=584 MEDIUMBLOB=583 MEDIUM=586 MAX_USER_CONNECTIONS=581 MAX_UPDATES_PER_HOUR=580 MAX_SIZE=578 MAX_ROWS=577
MAX_QUERIES_PER_HOUR=576 MAX_EXECUTION_TIME=1000 MAX_CONNECTIONS_PER_HOUR=575 MAXVALUE=582 MAX=579 MATERIALIZED=1236 MATERIALIZATION=1008 MATCH=574
MASTER=571 MANUAL=1212 LOW_PRIORITY=548 LOOSESCAN=1007 LOOP=547 LONGTEXT=544 LONGBLOB=543 LONG=546 LOGS=542 LOGFILE=541 LOG=1206 LOCKS=539 LOCKED=924
LOCK=540 LOCALTIMESTAMP=623 LOCALTIME=623 LOCAL=537 LOAD=536 LIST=535 LINESTRING=534 LINES=533 LINEAR=532 LIMIT=531 LIKE=530 LIBRARY=1218 LEVEL=528
LESS=527 LEFT=526 LEAVES=524 LEAVE=525 LEADING=523 LEAD=940 LATERAL=975 LAST_VALUE=939 LAST=521 LANGUAGE=520 LAG=938 KILL=519 KEY_BLOCK_SIZE=517
KEYS=516 KEYRING=1190 KEY=518 JSON_VALUE=1151 JSON_TABLE=955 JSON_OBJECTAGG=920 JSON_DUALITY_OBJECT=1222 JSON_ARRAYAGG=921 JSON=515 JOIN_SUFFIX=1022
JOIN_PREFIX=1021 JOIN_ORDER=1023 JOIN_INDEX=1041 JOIN_FIXED_ORDER=1024 JOIN=513 ITERATE=512 ISSUER=511 ISOLATION=510 IS=509 IPC=508 IO_THREAD=702
IO_BEFORE_GTIDS=506 IO_AFTER_GTIDS=505 IO=507 INVOKER=503 INVISIBLE=911 INTOEXISTS=1006 INTO=501 INTERVAL=500 INTERSECT=1200 INTEGER=502 INT=502
INT8=289 INT4=502 INT3=584 INT2=768 INT1=836 INSTANCE=498 INSTALL=499 INSERT_METHOD=497 INSERT=496 INSENSITIVE=495 INOUT=494 INNER=493 INITIATE=1194
INITIAL_SIZE=492 INITIAL=1197 INFILE=491 INDEX_MERGE=1025 INDEXES=489 INDEX=490 INACTIVE=974 IN=504 IMPORT=488 IGNORE_SERVER_IDS=487 IGNORE=486 IF=485
IDENTIFIED=483 HOUR_SECOND=480 HOUR_MINUTE=479 HOUR_MICROSECOND=478 HOUR=481 HOSTS=477 HOST=476 HISTORY=959 HISTOGRAM=928 HIGH_PRIORITY=475 HELP=473
HEADER=1217 HAVING=472 HASH_JOIN=1030 HASH=471 HANDLER=470 GUIDED=1237 GTID_ONLY=1199 GTIDS=1207 GROUP_REPLICATION=459 GROUP_INDEX=1043
GROUP_CONCAT=468 GROUPS=937 GROUPING=926 GROUP=467 GRANTS=466 GRANT=465 GLOBAL=464 GET_SOURCE_PUBLIC_KEY=1162 GET_MASTER_PUBLIC_KEY=967 GET_FORMAT=462
GET=463 GEOMETRYCOLLECTION=460 GEOMETRY=461 GEOMCOLLECTION=460 GENERATED=458 GENERATE=1203 GENERAL=457 FUNCTION=455 FULLTEXT=454 FULL=453 FROM=452
FOUND=451 FORMAT=450 FOREIGN=448 FORCE=447 FOR=449 FOLLOWS=446 FOLLOWING=936 FLUSH=445 FLOAT=444 FLOAT8=397 FLOAT4=444 FIXED=442 FIRST_VALUE=935
FIRSTMATCH=1005 FIRST=441 FINISH=1193 FILTER=440 FILE_PREFIX=1228 FILE_PATTERN=1227 FILE_NAME=1226 FILE_FORMAT=1224 FILE_BLOCK_SIZE=439 FILES=1225
FILE=438 FIELDS=328 FETCH=437 FAULTS=436 FAST=435 FALSE=434 FAILED_LOGIN_ATTEMPTS=995 FACTOR=1192 EXTRACT=433 EXTERNAL_FORMAT=1234 EXTERNAL=1235
EXTENT_SIZE=432 EXTENDED=431 EXPORT=430 EXPLAIN=387 EXPIRE=429 EXPANSION=428 EXIT=427 EXISTS=426 EXECUTE=425 EXCLUDE=934 EXCHANGE=424 EXCEPT=913
EVERY=423 EVENTS=421 EVENT=422 ESCAPED=419 ESCAPE=420 ERRORS=418 ERROR=417 ENUM=414 ENGINE_ATTRIBUTE=1154 ENGINES=412 ENGINE=413 ENFORCED=985 ENDS=410
END=409 ENCRYPTION=339 ENCLOSED=408 ENABLE=407 EMPTY=954 ELSEIF=406 ELSE=405 EACH=404 DYNAMIC=403 DUPSWEEDOUT=1004 DUPLICATE=402 DUMPFILE=401
DUALITY=1220 DUAL=400 DROP=399 DOUBLE=397 DO=398 DIV=396 DISTINCTROW=395 DISTINCT=395 DISK=394 DISCARD=393 DISABLE=392 DIRECTORY=391 DIAGNOSTICS=390
DETERMINISTIC=389 DESCRIPTION=970 DESCRIBE=387 DESC=386 DERIVED_CONDITION_PUSHDOWN=1047 DENSE_RANK=933 DELETE=385 DELAY_KEY_WRITE=384 DELAYED=383
DEFINITION=969 DEFINER=382 DEFAULT_AUTH=381 DEFAULT=380 DECLARE=379 DECIMAL=378 DEC=378 DEALLOCATE=376 DAY_SECOND=374 DAY_MINUTE=373
DAY_MICROSECOND=372 DAY_HOUR=371 DAY=375 DATE_SUB=369 DATE_ADD=368 DATETIME=367 DATE=370 DATAFILE=365 DATABASES=364 DATABASE=363 DATA=366 CURTIME=362
CURSOR_NAME=361 CURSOR=360 CURRENT_USER=359 CURRENT_TIMESTAMP=623 CURRENT_TIME=362 CURRENT_DATE=357 CURRENT=358 CURDATE=357 CUME_DIST=932 CUBE=356
CROSS=355 CREATE=354 CPU=353 COUNT=352 CONVERT=351 CONTINUE=350 CONTEXT=349 CONTAINS=348 CONSTRAINT_SCHEMA=347 CONSTRAINT_NAME=346
CONSTRAINT_CATALOG=345 CONSTRAINT=344 CONSISTENT=343 CONNECTION=342 CONDITION=341 CONCURRENT=340 COMPRESSION=338 COMPRESSED=337 COMPONENT=914
COMPLETION=336 COMPACT=335 COMMITTED=333 COMMIT=334 COMMENT=332 COLUMN_NAME=331 COLUMN_FORMAT=330 COLUMNS=328 COLUMN=329 COLLATION=327 COLLATE=326
CODE=325 COALESCE=324 CLOSE=323 CLONE=931 CLIENT=322 CLASS_ORIGIN=321 CIPHER=320 CHECKSUM=318 CHECK=319 CHARSET=316 CHARACTER=317 CHAR=317 CHANNEL=315
CHANGED=314 CHANGE=313 CHALLENGE_RESPONSE=1198 CHAIN=312 CATALOG_NAME=311 CAST=310 CASE=309 CASCADED=308 CASCADE=307 CALL=306 CACHE=305 BYTE=304
BY=303 BULK=1201 BUCKETS=929 BTREE=302 BOTH=301 BOOLEAN=299 BOOL=300 BNL=1003 BLOCK=298 BLOB=297 BKA=1002 BIT_XOR=296 BIT_OR=294 BIT_AND=293 BIT=295
BINLOG=291 BINARY=290 BIGINT=289 BETWEEN=288 BERNOULLI=1213 BEGIN=287 BEFORE=286 BACKUP=285 AVG_ROW_LENGTH=283 AVG=284 AUTO_REFRESH_SOURCE=1231
AUTO_REFRESH=1230 AUTO_INCREMENT=282 AUTOEXTEND_SIZE=281 AUTO=1211 AUTHENTICATION=1191 ATTRIBUTE=1153 AT=280
ASSIGN_GTIDS_TO_ANONYMOUS_TRANSACTIONS=1161 ASENSITIVE=279 ASCII=278 ASC=277 AS=276 ARRAY=976 ANY=275 AND=274 ANALYZE=272 ALWAYS=270 ALTER=269
ALLOW_MISSING_FILES=1229 ALL=268 ALGORITHM=267 AGGREGATE=266 AGAINST=265 AFTER=264 ADMIN=910 ADDDATE=263 ADD=262 ACTIVE=973 ACTION=261 ACCOUNT=260
ACCESSIBLE=259 ABSENT=1223 >>=760 >==456 >=469 ==415 <>=614 <=>=416 <==522 <=549 <<=759 &&=273 !==614
"""

#: Names in optimizer hints.
_HINTS = """
SUBQUERY=1018 SKIP_SCAN=1028 SET_VAR=1027 SEMIJOIN=1017 RESOURCE_GROUP=1001 QB_NAME=1016 ORDER_INDEX=1045 NO_SKIP_SCAN=1029 NO_SEMIJOIN=1014
NO_RANGE_OPTIMIZATION=1013 NO_ORDER_INDEX=1046 NO_MRR=1012 NO_MERGE=1020 NO_JOIN_INDEX=1042 NO_INDEX_MERGE=1026 NO_INDEX=1040 NO_ICP=1011
NO_HASH_JOIN=1031 NO_GROUP_INDEX=1044 NO_DERIVED_CONDITION_PUSHDOWN=1048 NO_BNL=1010 NO_BKA=1009 MRR=1015 MERGE=1019 MAX_EXECUTION_TIME=1000
MATERIALIZATION=1008 LOOSESCAN=1007 JOIN_SUFFIX=1022 JOIN_PREFIX=1021 JOIN_ORDER=1023 JOIN_INDEX=1041 JOIN_FIXED_ORDER=1024 INTOEXISTS=1006
INDEX_MERGE=1025 INDEX=1039 HASH_JOIN=1030 GROUP_INDEX=1043 FIRSTMATCH=1005 DUPSWEEDOUT=1004 DERIVED_CONDITION_PUSHDOWN=1047 BNL=1003 BKA=1002
"""

#: Words that only 5.7 has.
_WORDS_57 = """
WITH_CUBE=893 UDF_RETURNS=848 TABLE_REF_PRIORITY=820 SQL_CACHE=784 SERVER_OPTIONS=755 REDOFILE=693 PARSE_GCOL_EXPR=654 MASTER_USER=573
MASTER_TLS_VERSION=572 MASTER_SSL_VERIFY_SERVER_CERT=570 MASTER_SSL_KEY=569 MASTER_SSL_CRLPATH=568 MASTER_SSL_CRL=567 MASTER_SSL_CIPHER=566
MASTER_SSL_CERT=565 MASTER_SSL_CAPATH=564 MASTER_SSL_CA=563 MASTER_SSL=562 MASTER_SERVER_ID=561 MASTER_RETRY_COUNT=559 MASTER_PORT=558
MASTER_PASSWORD=557 MASTER_LOG_POS=556 MASTER_LOG_FILE=555 MASTER_HOST=554 MASTER_DELAY=553 MASTER_CONNECT_RETRY=552 MASTER_BIND=551
MASTER_AUTO_POSITION=550 LOCATOR=538 DES_KEY_FILE=388 ANALYSE=271
"""

#: Of words that share an id, the one that a digest text shows.
_SHOWN = """
YEAR WEEK VAR_POP VARCHARACTER USER TINYINT SUBSTRING STDDEV_POP SQL_TSI_SECOND SQL_TSI_QUARTER SQL_TSI_MONTH SQL_TSI_MINUTE SQL_TSI_HOUR SQL_TSI_DAY
SOME SMALLINT SCHEMAS SCHEMA RLIKE RELAY_THREAD NOW NDBCLUSTER MIDDLEINT INTEGER INT8 GEOMETRYCOLLECTION FLOAT8 FLOAT4 FIELDS EXPLAIN DISTINCTROW
DECIMAL CURTIME CURDATE CHARACTER !=
"""

#: Spellings that are no words, by id.
_SPELLED = {
    1112: 'UNUSED',
    1111: '(by_num_col)',
    1110: 'IN (...)',
    1109: '*/',
    1108: '/*+',
    1107: '(tok_id_at)',
    1106: '(tok_id)',
    1105: '(...) /* , ... */',
    1104: '(...)',
    1103: '(?) /* , ... */',
    1102: '(?)',
    1101: '?, ...',
    1100: '?',
    907: '->>',
    894: 'WITH ROLLUP',
    852: '(_charset)',
    849: '(ulonglong)',
    827: '(text)',
    757: ':=',
    652: '?',
    642: '||',
    628: '(num)',
    621: '!',
    611: '(nchar)',
    545: '(long)',
    529: '(hostname)',
    514: '->',
    484: '(id_quoted)',
    482: '(id)',
    474: '(hex)',
    443: '(float)',
    377: '(decimal)',
    292: '(bin)',
}

#: Words that came with 8.4 and with 9.0, and those that 8.4 took away.
_SINCE_84 = """
TABLESAMPLE S3 QUALIFY PARSE_TREE PARALLEL MANUAL LOG GTIDS BERNOULLI AUTO
"""
_SINCE_90 = """
VERIFY_KEY_CONSTRAINTS VECTOR VALIDATE URI STRICT_LOAD SETS RELATIONAL PARAMETERS MATERIALIZED LIBRARY JSON_DUALITY_OBJECT HEADER GUIDED FILE_PREFIX
FILE_PATTERN FILE_NAME FILE_FORMAT FILES EXTERNAL_FORMAT EXTERNAL DUALITY AUTO_REFRESH_SOURCE AUTO_REFRESH ALLOW_MISSING_FILES ABSENT
"""
_UNTIL_80 = """
GET_MASTER_PUBLIC_KEY
"""

#: Spellings of ids that have none, in 8.0 and in 5.7.
_OLD_80 = """
MASTER_ZSTD_COMPRESSION_LEVEL=990 MASTER_TLS_VERSION=572 MASTER_TLS_CIPHERSUITES=992 MASTER_SSL_VERIFY_SERVER_CERT=570 MASTER_SSL_KEY=569
MASTER_SSL_CRLPATH=568 MASTER_SSL_CRL=567 MASTER_SSL_CIPHER=566 MASTER_SSL_CERT=565 MASTER_SSL_CAPATH=564 MASTER_SSL_CA=563 MASTER_SSL=562
MASTER_SERVER_ID=561 MASTER_RETRY_COUNT=559 MASTER_PUBLIC_KEY_PATH=966 MASTER_PORT=558 MASTER_PASSWORD=557 MASTER_LOG_POS=556 MASTER_LOG_FILE=555
MASTER_HOST=554 MASTER_HEARTBEAT_PERIOD=573 MASTER_DELAY=553 MASTER_CONNECT_RETRY=552 MASTER_COMPRESSION_ALGORITHMS=989 MASTER_BIND=551
MASTER_AUTO_POSITION=550 GET_MASTER_PUBLIC_KEY=967
"""
_OLD_57 = """
WITH_CUBE=893 UDF_RETURNS=848 TABLE_REF_PRIORITY=820 SQL_CACHE=784 SERVER_OPTIONS=755 REDOFILE=693 PARSE_GCOL_EXPR=654 MASTER_USER=573
MASTER_TLS_VERSION=572 MASTER_SSL_VERIFY_SERVER_CERT=570 MASTER_SSL_KEY=569 MASTER_SSL_CRLPATH=568 MASTER_SSL_CRL=567 MASTER_SSL_CIPHER=566
MASTER_SSL_CERT=565 MASTER_SSL_CAPATH=564 MASTER_SSL_CA=563 MASTER_SSL=562 MASTER_SERVER_ID=561 MASTER_RETRY_COUNT=559 MASTER_PORT=558
MASTER_PASSWORD=557 MASTER_LOG_POS=556 MASTER_LOG_FILE=555 MASTER_HOST=554 MASTER_DELAY=553 MASTER_CONNECT_RETRY=552 MASTER_BIND=551
MASTER_AUTO_POSITION=550 LOCATOR=538 DES_KEY_FILE=388 ANALYSE=271
"""

#: Ids of 5.7 in runs: id, id in 5.7, how many that follow each other in both.
_RUNS_57 = """
258:258:257 515:516:45 561:561:1 562:570:1 563:564:1 564:562:1 565:565:5 570:571:2 572:563:1 573:573:1 574:575:9 586:587:16 605:606:302 907:515:1
920:908:2 1000:910:1 1002:911:17 1032:928:3 1037:931:1 1100:928:10
"""

#: Tokens after which a sign belongs to the number that follows.
STARTS_EXPRESSION = frozenset(
    map(int, """
903 891 890 889 875 863 830 793 760 759 756 748 729 697 645 644 642 632 622 614 600 549 531 530 522 504 500 485 472 469 456 423 416 415 410 406 405
396 380 309 303 288 280 276 274 273 126 124 94 61 47 45 44 43 42 40 38 37
""".split())
)

VERSIONS = ("8.0", "8.4", "9.0", "5.7")

#: Token ids that rules name.
END, ABORT = 411, 258
IDENT, QUOTED_IDENT, HOSTNAME, STRING, NATIONAL_STRING = 482, 484, 529, 827, 611
NUM, LONG, UNSIGNED_LONG, DECIMAL, FLOAT, BINARY, HEX = 628, 545, 849, 377, 443, 292, 474
NULL, IS, NOT, IN, ASSIGN, ARROW, LONG_ARROW, DOLLAR_STRING = 627, 509, 622, 504, 757, 514, 907, 1204
VALUE, VALUES, ROW, ROWS, WIDE_ROW, WIDE_ROWS, IN_VALUES, NAME = 1100, 1101, 1102, 1103, 1104, 1105, 1110, 1106
HINT_OPEN, HINT_CLOSE = 1108, 1109
UNUSED_57 = 938
#: After these a comment that starts with a plus sign is an optimizer hint: SELECT, INSERT, UPDATE, DELETE, REPLACE.
HINTABLE = frozenset((748, 496, 864, 385, 711))
NUMBERS = frozenset((NUM, LONG, UNSIGNED_LONG, DECIMAL, FLOAT, BINARY, HEX))
STRINGS = frozenset((HOSTNAME, STRING, NATIONAL_STRING))


def _pairs(text: str) -> dict[bytes, int]:
    # A word may hold equals signs itself.
    return {w.encode(): int(i) for w, _, i in (x.rpartition("=") for x in text.split())}


_ALL = _pairs(_WORDS)
HINTS = _pairs(_HINTS)

#: Ids of 8.0 and what 5.7 hashes for them.
TO_57 = {a + k: b + k for a, b, n in (map(int, x.split(":")) for x in _RUNS_57.split()) for k in range(n)}


def _without(*lists: str) -> dict[bytes, int]:
    gone = {w.encode() for text in lists for w in text.split()}
    return {w: i for w, i in _ALL.items() if w not in gone}


#: By version, the words that are keywords.
KEYWORDS: dict[str, dict[bytes, int]] = {
    "8.0": _without(_SINCE_84, _SINCE_90),
    "8.4": _without(_UNTIL_80, _SINCE_90),
    "9.0": _without(_UNTIL_80),
    "5.7": {w: i for w, i in _ALL.items() if i in TO_57} | _pairs(_WORDS_57),
}

#: What the version number in a comment is held against. 9.0 has none, so numbered comments are never run there.
THRESHOLD = {"8.0": 80000, "8.4": 80400, "9.0": 0, "5.7": 50700}


def _texts(version: str) -> dict[int, bytes]:
    out = {i: chr(i).encode() for i in range(256)}
    shown = {w.encode() for w in _SHOWN.split()}
    for words in (_ALL, HINTS):
        for w, i in words.items():
            if i not in out or w in shown:
                out[i] = w
    out.pop(_ALL[b"GET_MASTER_PUBLIC_KEY"])  # a word without a spelling but in 8.0
    out |= {i: s.encode() for i, s in _SPELLED.items()}
    old = {"8.0": _OLD_80, "5.7": _OLD_57}.get(version, "")
    return out | {i: w for w, i in _pairs(old).items()}


#: By version, what a token id looks like in a digest text; ids that are not here look like nothing.
TEXTS = {v: _texts(v) for v in VERSIONS}
