"""Statements that used to be lost without a word, in each format; and every line is a statement or a warning."""

from lakeatlas.sources import corpus


def files(spark, *texts):
    return spark.createDataFrame([("p", f"f{i}", t) for i, t in enumerate(texts)], "project string, path string, content string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_dbml(spark):
    text = """Table users {
  id int [pk]
  name varchar
}
Table posts {
  user_id int [not null, ref: > users.id, note: 'a, b']
  editor_id int [ref: - users.id, shiny]
  reviewer_id int
  tag_id int [ref: > tags.id]
  ???
  indexes {
    user_id [unique]
    (user_id, editor_id)
    !
  }
}
Table users {
  other int
}
Ref {
  posts.reviewer_id > users.id
  nonsense
}
Ref more { users.id <> posts.user_id }
Ref: posts.gone > users.id
Enum kinds {
  a
}
whatever
"""
    got = corpus.dbml(files(spark, text))
    assert rows(got["columns"], "table_name", "name") == [("posts", "editor_id"), ("posts", "reviewer_id"), ("posts", "tag_id"), ("posts", "user_id"), ("users", "id"), ("users", "name")]
    assert rows(got["refs"], "table_name", "column_name", "ref_table", "one_to_one") == [("posts", "editor_id", "users", True), ("posts", "reviewer_id", "users", False), ("posts", "user_id", "users", False)]
    assert rows(got["pairs"], "table_name", "target") == [("users", "posts")]
    assert rows(got["indexes"], "columns", "unique") == [(["user_id", "editor_id"], False), (["user_id"], True)]
    assert rows(got["warnings"], "line", "message") == [
        (13, "unknown statement: !"),
        (16, "duplicate table, later definition ignored: users"),
        (21, "unknown statement: nonsense"),
        (24, "Ref to unknown column: posts.gone"),
        (28, "unknown statement: whatever"),
        (6, "unknown setting: shiny"),
        (8, "Ref to unknown table: tags"),
        (9, "unknown statement: ???"),
    ]


def test_schema_rb(spark):
    text = """ActiveRecord::Schema.define do
  create_table "posts" do |t|
    t.string "a", "b", null: false
    t.references :author, foreign_key: { to_table: :users }, type: :uuid
    t.references :owner, polymorphic: true, foreign_key: true
    t.references :thing, foreign_key: true, index: { unique: true }
    t.text :body, default: "x"
  end
  create_table "users" do |t|
  end
end
"""
    got = corpus.schema_rb(files(spark, text))
    assert rows(got["columns"].where("table_name = 'posts'"), "pos", "name", "type", "nullable")[:4] == [(1, "id", "bigint", False), (2, "a", "string", False), (3, "b", "string", False), (4, "author_id", "uuid", True)]
    assert rows(got["edges"], "table_name", "type", "name", "target", "foreign_key") == [("posts", "belongs_to", "author", "users", "author_id")]
    assert [r.message for r in got["warnings"].collect()] == ["foreign key, unknown target: posts.thing_id -> things"]
    assert rows(got["indexes"].where("unique"), "columns") == [(["thing_id"],)]


def test_prisma(spark):
    text = """enum Role {
  A
}
model Member {
  orgId Int @map("org_id")
  userId Int?
  org Org @relation(fields: [orgId, userId], references: [id, uid])
  @@id([orgId, userId])
  @@@
}
model Org {
  id Int @id
  uid Int
  badgeId Int
  badge Badge @relation(fields: [badgeId], references: [id])
  members Member[]
  @@unique([badgeId])
}
model Badge {
  id Int @id
  org Org?
}
oops
"""
    got = corpus.prisma(files(spark, text))
    assert rows(got["edges"], "table_name", "type", "name", "target", "foreign_key") == [("Badge", "has_one", "org", "Org", None), ("Member", "belongs_to", "org", "Org", "org_id"), ("Org", "has_one", "badge", "Badge", "badgeId")]
    assert rows(got["fields"].where("table_name = 'Member'"), "name", "primary", "nullable") == [("org_id", True, False), ("userId", True, False)]
    assert rows(got["warnings"], "message") == [("key over several fields, the first stands for it: org",), ("unknown statement: @@@",), ("unknown statement: oops",)]


def test_mermaid(spark):
    text = "erDiagram\n  %% note\n  a ||--o{ b : has\n  a {\n    int id PK\n    !\n  }\n  a {\n    int z\n  }\n  what is this\n"
    got = corpus.mermaid(files(spark, text))
    assert rows(got["columns"], "table_name", "name") == [("a", "id")]
    assert rows(got["warnings"], "line", "message") == [(10, "unknown statement: what is this"), (5, "unknown statement: !"), (7, "duplicate entity, later definition ignored: a")]


def test_laravel(spark):
    model = """<?php
use Illuminate\\Database\\Eloquent\\Model;
/* class Old extends Model {
   function x() { return $this->hasMany(Gone::class); } */
final class Post extends Model
{
    protected $table = 'articles';
    public function author() { return $this->belongsTo(
        User::class,
        'writer_id'
    ); }
    // public function nope() { return $this->hasMany(Nope::class); }
    public function tags() { return $this->belongsToMany('App\\Models\\Tag', 'post_tag'); }
    public function images() { return $this->morphMany(Image::class, 'imageable'); }
    public function odd() { return $this->hasMany($this->cls); }
}
class User extends \\App\\BaseModel { public function posts() { return $this->hasMany(Post::class); } }
"""
    other = "<?php\nclass Image extends Model { public function imageable() { return $this->morphTo(); } }\nclass UserController extends Controller { function a() { $this->hasMany(User::class); } }\n"
    docs = spark.createDataFrame([("p", "app/Post.php", model), ("p", "app/Image.php", other), ("p", "vendor/x/Y.php", other.replace("Image", "Vendor"))], "project string, path string, content string")
    got = corpus.laravel_models(docs)
    assert rows(got["tables"], "cls", "real") == [("Image", "images"), ("Post", "articles"), ("User", "users")]
    assert rows(got["edges"], "table_name", "type", "name", "target", "foreign_key", "through", "polymorphic") == [
        ("articles", "belongs_to", "author", "users", "writer_id", None, False),
        ("articles", "has_and_belongs_to_many", "tags", "tags", None, "post_tag", False),
        ("articles", "has_many", "images", "images", None, None, True),
        ("images", "belongs_to", "imageable", "imageables", "imageable_id", None, True),
        ("users", "has_many", "posts", "articles", None, None, False),
    ]
    assert rows(got["warnings"], "path", "line", "message") == [("app/Post.php", 15, "relation without a class: odd hasMany($this->cls)")]
    moved = corpus.laravel_models(docs, spark.createDataFrame([("p", "User", "people")], "schema_id string, model string, table_name string"))
    assert rows(moved["edges"].where("name IN ('author', 'posts')"), "table_name", "target") == [("articles", "people"), ("people", "articles")]
