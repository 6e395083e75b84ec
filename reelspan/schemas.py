"""Table schemas. Times are milliseconds (BIGINT); readers convert seconds at the edge."""

from __future__ import annotations

SPANS = "rec_id bigint, st bigint, en bigint"
WORDS = "array<struct<word:string,st:bigint,en:bigint,probability:double>>"
SEGMENTS = (
    "rec_id string, seg_id bigint, st bigint, en bigint, text string, speaker string, "
    "avg_logprob double, no_speech_prob double, compression_ratio double, temperature double"
)
TURNS = "rec_id string, turn_idx bigint, st bigint, en bigint, speaker string"

#: One result document, as stored: seconds as doubles, unknown keys ignored, absent ones null.
RESULT_DOCUMENT = """
schema_version int,
source struct<name:string,path:string,size_bytes:bigint,sha256:string,modified_at:string>,
probe struct<duration:double,format_name:string,bit_rate:bigint,nb_streams:int,tags:map<string,string>>,
language struct<code:string,probability:double,source:string>,
segments array<struct<id:bigint,start:double,end:double,text:string,speaker:string,avg_logprob:double,no_speech_prob:double,
  compression_ratio:double,temperature:double,words:array<struct<start:double,end:double,word:string,probability:double>>>>,
coverage struct<analyzed:boolean,covered_seconds:double,ratio:double,silence_seconds:double,gap_seconds:double,gaps:array<array<double>>,low_coverage:boolean,reason:string>,
stats struct<words:bigint,unique_words:bigint,characters:bigint,characters_no_spaces:bigint,words_per_minute:double,top_words:array<struct<word:string,count:bigint>>>,
speakers array<struct<speaker:string,seconds:double,ratio:double,segments:bigint>>,
diarization struct<available:boolean,backend:string,speaker_count:bigint,reason:string>,
text string,
summary struct<available:boolean,summary:string,topics:array<string>,action_items:array<string>,quotes:array<string>,reason:string>,
visual struct<enabled:boolean,effective_resolution:string,display_resolution:string,scene_cuts:bigint,scene_threshold:double,thumbnails:array<string>,
  thumbnail_interval:double,reason:string>,
diagnostics struct<mean_volume_db:double,max_volume_db:double,clipping_samples:bigint,clipping_suspected:boolean,silence_seconds:double,silence_ratio:double,
  speech_seconds:double,speech_ratio:double,vad_segments:bigint,speech_detected:boolean,warnings:array<string>>,
processing struct<engine:string,model:string,device:string,elapsed_seconds:double,realtime_factor:double,finished_at:string>,
outputs map<string,string>,
partial_failures array<string>
"""

HISTORY = (
    "run_id string, finished_at string, file_name string, input_path string, output_dir string, report_path string, transcript_path string, "
    "status string, detail string, duration double, model string, device string, realtime_factor double, coverage double, gaps int, "
    "gap_seconds double, failures int, summarized boolean, confidence double"
)

PROBE_DOCUMENT = """
format struct<filename:string,format_name:string,format_long_name:string,duration:string,bit_rate:string,nb_streams:string,tags:map<string,string>>,
streams array<struct<index:int,codec_type:string,codec_name:string,codec_long_name:string,profile:string,width:string,height:string,
  coded_width:string,coded_height:string,sample_aspect_ratio:string,display_aspect_ratio:string,r_frame_rate:string,avg_frame_rate:string,
  pix_fmt:string,color_space:string,color_primaries:string,color_transfer:string,bit_rate:string,nb_frames:string,duration:string,
  sample_rate:string,channels:string,channel_layout:string,bits_per_sample:string,bits_per_raw_sample:string,
  tags:map<string,string>,disposition:map<string,string>,side_data_list:array<struct<rotation:string>>>>,
chapters array<struct<id:string,start_time:string,end_time:string,tags:map<string,string>>>
"""

#: Streams and chapters of a probed recording, as probe_documents gives them.
VIDEO_STREAM = (
    "struct<index:int,codec:string,codec_long:string,profile:string,width:bigint,height:bigint,coded_width:bigint,coded_height:bigint,sar:string,dar:string,fps:double,avg_fps:double,"
    "pix_fmt:string,color_space:string,color_primaries:string,color_transfer:string,is_hdr:boolean,bit_rate:bigint,nb_frames:bigint,rotation:bigint,duration:double,language:string>"
)
AUDIO_STREAM = (
    "struct<index:int,codec:string,codec_long:string,profile:string,sample_rate:bigint,channels:bigint,channel_layout:string,bit_rate:bigint,bits_per_sample:bigint,duration:double,"
    "language:string,title:string>"
)
SUBTITLE_STREAM = "struct<index:int,codec:string,language:string,title:string>"
CHAPTER = "struct<index:bigint,start:double,end:double,title:string>"

PROGRESS_EVENT = "job string, ts timestamp, t string, stage string, fraction double, message string"
DOWNLOAD_EVENT = "status string, completed double, total double, error string"
LEDGER = "job_key string, stage string, saved_at timestamp, format_version int, attempts int, diarize_key string, payload string"
