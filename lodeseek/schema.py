"""Schemas of the data model, as DDL."""

BOX = "struct<x:float,y:float,width:float,height:float>"
ORIGIN = f"struct<origin_type:string,line:int,col:int,page:int,bbox:{BOX}>"
SEGMENT = f"struct<start:bigint,end:bigint,origin:{ORIGIN}>"
FILES = "path string, size_bytes long, content binary"
DOCUMENTS = f"path string, file_type string, text string, source_map array<{SEGMENT}>, title string, page_count int, error string"
INDEX = (
    "file_path string, chunk_idx int, byte_start long, byte_end long, origin_type string, page int, line int, col int, "
    "bbox_x double, bbox_y double, bbox_w double, bbox_h double, chunk_text string, embedding array<float>"
)
EVENTS = "path string, exists boolean, is_file boolean, ts timestamp"
MODELS = "engine string, model_id string, display_name string, description string, dimension int, is_cached boolean, is_recommended boolean"
